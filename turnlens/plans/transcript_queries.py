"""Queries over text, windows, documents, logs and metrics, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import intervals as I
from ..operators import transcripts as R
from ..operators import vectors as V
from . import fixtures as X

_S, _D, _V, _E, _FR = X.SENTENCES, X.DIAR, X.VAD, X.EMBEDDED, X.FRAMES
_DUR = "dur AS (SELECT job_id, CAST(max(end_ms) + 500 AS BIGINT) AS duration_ms FROM sentences GROUP BY job_id)"
Q = {}


def _sent(fn):
    return lambda spark, sf_dir: fn(X.sentences(spark, sf_dir))


def _docs(fn):
    return lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _ev(fn):
    return lambda spark, sf_dir: fn(X.events(spark, sf_dir))


def _emb(fn):
    return lambda spark, sf_dir: fn(X.embedded(spark, sf_dir))


# scalar functions
Q["F1_seconds_to_human"] = (
    _sent(lambda s: s.select("job_id", "ord", T.seconds_to_human("end_ms").alias("label"))),
    X.with_views(_S) + """ SELECT job_id, ord, CASE WHEN end_ms >= 3600000 THEN printf('%d:%02d:%02d', end_ms // 3600000, end_ms % 3600000 // 60000, end_ms // 1000 % 60)
      ELSE printf('%02d:%02d', end_ms // 60000, end_ms // 1000 % 60) END AS label FROM sentences""",
)
Q["F2_format_time_range"] = (
    _sent(lambda s: s.select("job_id", "ord", T.time_range("start_ms", "end_ms").alias("label"))),
    X.with_views(_S) + """ SELECT job_id, ord, CASE WHEN greatest(start_ms, end_ms) >= 3600000
      THEN printf('[%02d:%02d:%02d–%02d:%02d:%02d]', start_ms // 3600000, start_ms % 3600000 // 60000, start_ms // 1000 % 60, end_ms // 3600000, end_ms % 3600000 // 60000, end_ms // 1000 % 60)
      ELSE printf('[%02d:%02d–%02d:%02d]', start_ms // 60000, start_ms // 1000 % 60, end_ms // 60000, end_ms // 1000 % 60) END AS label FROM sentences""",
)
Q["F3_srt_timestamp"] = (
    _sent(lambda s: s.select("job_id", "ord", T.srt_time("start_ms").alias("stamp"))),
    X.with_views(_S) + " SELECT job_id, ord, printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms % 3600000 // 60000, start_ms // 1000 % 60, start_ms % 1000) AS stamp FROM sentences",
)
Q["F4_speaker_label"] = (
    _sent(lambda s: s.select("job_id", "ord", F.concat(F.lit("Speaker "), (F.col("speaker") + 1).cast("string")).alias("label"), (F.col("speaker") % 2).alias("colour"))),
    X.with_views(_S) + " SELECT job_id, ord, 'Speaker ' || CAST(speaker + 1 AS VARCHAR) AS label, speaker % 2 AS colour FROM sentences",
)
Q["F5_export_label"] = (
    _ev(lambda e: e.select("event_id", F.concat(F.lit("meeting-"), F.date_format(F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Ho_Chi_Minh"), "yyyyMMdd-HHmm")).alias("label"))),
    "SELECT event_id, 'meeting-' || strftime(ts + INTERVAL 7 HOUR, '%Y%m%d-%H%M') AS label FROM events",
)
Q["F6_sanitize_filename"] = (
    _docs(lambda d: d.select("doc_id", T.sanitize_filename("text").alias("name"))),
    r"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(text, '[<>:"/\\|?*\x00-\x1F]', '_', 'g'), '^[\s.]+|[\s.]+$', '', 'g') AS c FROM documents),
    b AS (SELECT doc_id, regexp_replace(substr(c, 1, 80), '[\s.]+$', '') AS s FROM a)
    SELECT doc_id, CASE WHEN s = '' THEN 'document' WHEN regexp_matches(upper(regexp_extract(s, '^[^.]*')), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '_' || s ELSE s END AS name FROM b""",
)
Q["F9_strip_recogniser_tags"] = (
    _sent(lambda s: s.select("job_id", "ord", T.strip_tags(F.concat(F.lit("<|vi|><|NEUTRAL|>"), "text")).alias("text"))),
    X.with_views(_S) + r" SELECT job_id, ord, regexp_replace('<|vi|><|NEUTRAL|>' || text, '^(?:<\|[^|]+\|>)+', '') AS text FROM sentences",
)
Q["F12_language_map"] = (
    _docs(lambda d: d.select("doc_id", F.coalesce(F.create_map(*map(F.lit, ("en", "English", "de", "German", "fr", "French", "es", "Spanish")))[F.lower("lang")], F.lit("unknown")).alias("language"))),
    "SELECT doc_id, CASE lower(lang) WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE 'unknown' END AS language FROM documents",
)
_ALPHABET = "etaoinshrdlu"
Q["F13_char_token_sum"] = (
    _sent(lambda s: s.select("job_id", "ord", F.aggregate(F.transform(F.split("text", ""), lambda c: F.position(c, F.lit(_ALPHABET)).cast("long") * F.when(c == "", 0).otherwise(1)), F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum"))),
    X.with_views(_S) + f" SELECT job_id, ord, CAST(coalesce(list_sum(list_transform(string_split(text, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE strpos('{_ALPHABET}', c) END)), 0) AS BIGINT) AS id_sum FROM sentences",
)
Q["F16_cosine_similarity"] = (
    _emb(lambda e: R.consecutive_similarity(e).filter("sim is not null").select("job_id", "ord", F.round("sim", 6).alias("sim"))),
    X.with_views(_E) + """, p AS (SELECT job_id, ord, CAST(embedding AS DOUBLE[]) AS b, CAST(lag(embedding) OVER (PARTITION BY job_id ORDER BY ord) AS DOUBLE[]) AS a FROM embedded)
    SELECT job_id, ord, round(list_dot_product(a, b) / ((sqrt(list_dot_product(a, a)) + 1e-8) * (sqrt(list_dot_product(b, b)) + 1e-8)), 6) AS sim FROM p WHERE a IS NOT NULL""",
)
Q["F17_duration_seconds"] = (
    _ev(lambda e: e.select("event_id", F.round(T.duration_seconds(F.format_string("%dm%d.5s", F.expr("event_id % 7"), F.expr("event_id % 60"))), 3).alias("seconds"))),
    "SELECT event_id, round((event_id % 7) * 60.0e0 + (event_id % 60) + 0.5e0, 3) AS seconds FROM events",
)
Q["F18_text_timing_weight"] = (
    _docs(lambda d: d.select("doc_id", T.timing_weight("text").alias("weight"))),
    r"SELECT doc_id, CAST(length(regexp_replace(text, '[ \t\n\r\f\x0B]+', '', 'g')) AS BIGINT) AS weight FROM documents",
)
Q["F19_json_values"] = (
    _ev(lambda e: e.select("event_id", F.get_json_object("props", "$.k").cast("double").alias("k"), F.get_json_object("props", "$.missing").cast("double").alias("missing"))),
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, CAST(json_extract_string(props, '$.missing') AS DOUBLE) AS missing FROM events",
)
Q["S16_float_to_pcm16"] = (
    _emb(lambda e: e.select("vec_id", F.posexplode("embedding").alias("dim", "x")).select("vec_id", F.col("dim").cast("long").alias("dim"), T.pcm16(F.col("x").cast("double") * 8).alias("pcm"))),
    """SELECT vec_id, dim, CAST(CASE WHEN x < 0 THEN ceil(x * 32768) ELSE floor(x * 32767) END AS INT) AS pcm
    FROM (SELECT vec_id, dim, greatest(-1.0e0, least(1.0e0, v * 8)) AS x FROM (SELECT vec_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) AS a) AS b""",
)
Q["W9_circle_pad"] = (
    _emb(lambda e: e.select("vec_id", F.posexplode(T.circle_pad("embedding", 150)).alias("pos", "x")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))),
    "SELECT vec_id, pos, CAST(embedding[CAST(pos % len(embedding) AS INT) + 1] AS DOUBLE) AS x FROM (SELECT vec_id, embedding, unnest(range(150)) AS pos FROM embeddings) AS t",
)
Q["S11_job_segment_scan"] = (
    _sent(lambda s: s.filter("job_id = 7").select("job_id", "ord", "start_ms", "end_ms")),
    X.with_views(_S) + " SELECT job_id, ord, start_ms, end_ms FROM sentences WHERE job_id = 7",
)
Q["S12_pending_work_scan"] = (
    _ev(lambda e: e.filter(F.col("event_type").isin("click", "signup")).select("event_id", "event_type")),
    "SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'signup')",
)
# projections and predicates
Q["P1_align_timestamps"] = (
    _sent(
        lambda s: s.withColumn("times", F.transform(F.split("text", ""), lambda c, k: F.struct((k * 10).cast("long").alias("s"), (k * 10 + 10).cast("long").alias("e"))))
        .select("job_id", "ord", F.posexplode(T.shift_times("times", "start_ms")).alias("place", "t"))
        .select("job_id", "ord", F.col("place").cast("long").alias("place"), F.col("t.s").alias("start_ms"), F.col("t.e").alias("end_ms"))
    ),
    X.with_views(_S) + """ SELECT job_id, ord, place, start_ms + place * 10 AS start_ms, start_ms + place * 10 + 10 AS end_ms
    FROM (SELECT job_id, ord, start_ms, unnest(range(greatest(length(text), 1))) AS place FROM sentences) AS t""",
)
Q["P3_pad_segments"] = (
    lambda spark, sf_dir: X.vad(spark, sf_dir).join(X.sentences(spark, sf_dir).groupBy("job_id").agg((F.max("end_ms") + 500).alias("d")), "job_id").select("job_id", "ord", F.greatest(F.lit(0).cast("long"), F.col("start_ms") - 100).alias("start_ms"), F.least("d", F.col("end_ms") + 100).alias("end_ms")),
    X.with_views(_S, _V, _DUR) + " SELECT job_id, ord, greatest(0, start_ms - 100) AS start_ms, least(duration_ms, end_ms + 100) AS end_ms FROM vad JOIN dur USING (job_id)",
)
_RAW = """raw AS (SELECT job_id, ord, start_ms * 16 - 900 + ord % 7 AS s, CASE WHEN ord % 11 = 3 THEN NULL ELSE end_ms * 16 + ord % 5 END AS e FROM vad),
len AS (SELECT job_id, max(end_ms) * 16 - 777 AS samples FROM vad GROUP BY job_id)"""


def _p5(spark, sf_dir):
    vad = X.vad(spark, sf_dir)
    raw = vad.selectExpr("job_id", "ord", "start_ms * 16 - 900 + ord % 7 AS start", "CASE WHEN ord % 11 = 3 THEN NULL ELSE end_ms * 16 + ord % 5 END AS end")
    return I.segments_of_samples(raw, vad.groupBy("job_id").agg((F.max("end_ms") * 16 - 777).alias("samples")), least_ms=1500)


Q["P5_normalize_vad"] = (
    _p5,
    X.with_views(_S, _V, _RAW) + """ SELECT * FROM (
      SELECT job_id, ord, greatest(s, 0) * 1000 // 16000 AS start_ms, CAST(ceil(least(e, samples) / 16.0e0) AS BIGINT) AS end_ms
      FROM raw JOIN len USING (job_id) WHERE e IS NOT NULL AND least(e, samples) > greatest(s, 0)) AS t WHERE end_ms - start_ms >= 1500""",
)
Q["P5_normalize_vad_ms"] = (
    lambda spark, sf_dir: I.segments_of_ms(X.vad(spark, sf_dir).selectExpr("job_id", "ord", "cast(start_ms as double) + 0.75 AS start", "cast(end_ms as double) - ord % 3 * 900.5 AS end"), least_ms=1200),
    X.with_views(_S, _V) + """ SELECT * FROM (SELECT job_id, ord, start_ms, CAST(trunc(end_ms - ord % 3 * 900.5e0) AS BIGINT) AS end_ms FROM vad) AS t
    WHERE end_ms - start_ms >= 1200""",
)
Q["P6_clip_sentence"] = (
    _sent(lambda s: s.withColumns({"lo": F.greatest(F.lit(0).cast("long"), F.expr("(end_ms - start_ms) div 4")), "hi": F.expr("(end_ms - start_ms) * 3 div 4")}).select("job_id", "ord", T.strip(F.array_join(F.filter(F.split("text", ""), lambda c, i: (i * 10 + 5 >= F.col("lo")) & (i * 10 + 5 < F.col("hi"))), "")).alias("text"))),
    X.with_views(_S) + r""", b AS (SELECT *, (end_ms - start_ms) // 4 AS lo, (end_ms - start_ms) * 3 // 4 AS hi FROM sentences)
    SELECT job_id, ord, regexp_replace(array_to_string(list_transform(list_filter(range(length(text)), lambda i: i * 10 + 5 >= lo AND i * 10 + 5 < hi), lambda i: substr(text, CAST(i + 1 AS INT), 1)), ''), '^\s+|\s+$', '', 'g') AS text FROM b""",
)
Q["P7_non_blank"] = (
    _docs(lambda d: d.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).filter(F.length(T.strip("line")) > 0).groupBy("doc_id").agg(F.count("*").alias("n_lines"))),
    r"SELECT doc_id, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) AS t WHERE length(regexp_replace(line, '^\s+|\s+$', '', 'g')) > 0 GROUP BY doc_id",
)
Q["P10_validate_transcript"] = (
    lambda spark, sf_dir: R.violations(
        X.sentences(spark, sf_dir).selectExpr("job_id", "ord", "start_ms - CASE WHEN ord % 5 = 0 THEN 300 ELSE 0 END AS start_ms", "end_ms + CASE WHEN ord % 7 = 6 THEN 90000 ELSE 0 END AS end_ms", "CASE WHEN ord % 4 = 3 THEN ' ' ELSE text END AS text"),
        X.sentences(spark, sf_dir).groupBy("job_id").agg((F.max("end_ms") + 500).alias("duration_ms")),
    ),
    X.with_views(_S, _DUR) + """, m AS (SELECT job_id, ord, start_ms - CASE WHEN ord % 5 = 0 THEN 300 ELSE 0 END AS s, end_ms + CASE WHEN ord % 7 = 6 THEN 90000 ELSE 0 END AS e, CASE WHEN ord % 4 = 3 THEN ' ' ELSE text END AS text, duration_ms FROM sentences JOIN dur USING (job_id))
    SELECT job_id, ord, 'start_negative' AS rule FROM m WHERE s < 0 UNION ALL SELECT job_id, ord, 'end_before_start' FROM m WHERE e < s
    UNION ALL SELECT job_id, ord, 'end_after_duration' FROM m WHERE e > duration_ms UNION ALL SELECT job_id, ord, 'text_blank' FROM m WHERE trim(text) = '' UNION ALL SELECT job_id, ord, 'duration_not_positive' FROM m WHERE duration_ms <= 0""",
)
Q["P12_needs_punctuation"] = (
    _docs(lambda d: d.withColumn("marks", F.length("text") - F.length(F.translate("text", ".!?。！？", ""))).select("doc_id", ((F.length("text") >= 80) & ((F.col("marks") == 0) | (F.length("text") / F.when(F.col("marks") > 0, F.col("marks")) > 240))).alias("needed")).select("doc_id", F.coalesce("needed", F.lit(False)).alias("needed"))),
    "WITH m AS (SELECT doc_id, length(text) AS n, length(text) - length(translate(text, '.!?。！？', '')) AS marks FROM documents) SELECT doc_id, n >= 80 AND (marks = 0 OR CAST(n AS DOUBLE) / marks > 240) AS needed FROM m",
)
# joins
Q["J11_apply_speaker_updates"] = (
    _sent(lambda s: s.alias("s").join(s.filter("ord % 3 = 1").select("job_id", "ord", F.when(F.col("ord") % 2 == 1, F.col("speaker") + 10).alias("new"), F.lit(True).alias("hit")), ["job_id", "ord"], "left").select("job_id", "ord", F.when(F.col("hit"), F.col("new")).otherwise(F.col("speaker")).alias("speaker"))),
    X.with_views(_S) + " SELECT job_id, ord, CASE WHEN ord % 3 = 1 THEN CASE WHEN ord % 2 = 1 THEN speaker + 10 END ELSE speaker END AS speaker FROM sentences",
)
Q["J12_source_job_navigation"] = (
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/customer.parquet").join(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("c_custkey") == F.col("o_custkey")).join(spark.read.parquet(f"{sf_dir}/nation.parquet"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name"),
    "SELECT o_orderkey, c_name, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey",
)
Q["J14_changed_rows"] = (
    _sent(lambda s: s.join(s.select("job_id", "ord", F.when(F.col("ord") % 4 == 2, None).otherwise(F.col("speaker") * (F.col("ord") % 2).cast("int")).alias("new")), ["job_id", "ord"]).filter(~F.col("speaker").eqNullSafe(F.col("new"))).select("job_id", "ord", "speaker", "new")),
    X.with_views(_S) + " SELECT * FROM (SELECT job_id, ord, speaker, CASE WHEN ord % 4 = 2 THEN NULL ELSE speaker * CAST(ord % 2 AS INT) END AS new FROM sentences) AS t WHERE speaker IS DISTINCT FROM new",
)
# documents and persistence
Q["K2_generated_ids"] = (
    _sent(lambda s: s.select("job_id", "ord", F.row_number().over(W.partitionBy("job_id").orderBy("start_ms", "end_ms", "ord")).cast("long").alias("segment_id"))),
    X.with_views(_S) + " SELECT job_id, ord, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, ord) AS segment_id FROM sentences",
)
Q["K5_idempotent_insert"] = (
    _sent(lambda s: R.best_versions(s.unionByName(s.filter("ord % 2 = 0")).select("job_id", "start_ms", "end_ms", "ord"), ["job_id", "start_ms", "end_ms"], [F.col("ord")]).filter("rn = 1").drop("rn")),
    X.with_views(_S) + " SELECT job_id, start_ms, end_ms, min(ord) AS ord FROM sentences GROUP BY job_id, start_ms, end_ms",
)
Q["K7_unique_documents"] = (
    _docs(lambda d: R.best_rows(d.select("doc_id", "source", "lang", F.length(T.strip("text")).alias("size")), ["source", "lang"], F.struct("size", "doc_id")).select("doc_id", "kept")),
    r"SELECT doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY length(regexp_replace(text, '^\s+|\s+$', '', 'g')) DESC, doc_id DESC) = 1 AS kept FROM documents",
)
Q["K8_cascade_delete"] = (
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet").join(spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_acctbal < 0"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey"),
    "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < 0)",
)
Q["K9_srt_document"] = (
    _sent(lambda s: R.ordered_join(s.withColumn("n", F.row_number().over(W.partitionBy("job_id").orderBy("ord"))), F.concat(F.col("n").cast("string"), F.lit("\n"), T.srt_time("start_ms"), F.lit(" --> "), T.srt_time("end_ms"), F.lit("\n"), "text", F.lit("\n")), "\n", "srt")),
    X.with_views(_S) + """, t AS (SELECT job_id, ord, text, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS n,
      printf('%02d:%02d:%02d,%03d', start_ms // 3600000, start_ms % 3600000 // 60000, start_ms // 1000 % 60, start_ms % 1000) AS a, printf('%02d:%02d:%02d,%03d', end_ms // 3600000, end_ms % 3600000 // 60000, end_ms // 1000 % 60, end_ms % 1000) AS b FROM sentences)
    SELECT job_id, string_agg(CAST(n AS VARCHAR) || chr(10) || a || ' --> ' || b || chr(10) || text || chr(10), chr(10) ORDER BY ord) AS srt FROM t GROUP BY job_id""",
)
Q["K12_llm_payload"] = (
    _sent(lambda s: s.select("job_id", "ord", F.concat(F.lit("Speaker "), F.coalesce(F.when(F.col("ord") % 3 != 0, F.col("speaker")), F.lit(0)).cast("string")).alias("speaker"), (F.col("start_ms") / 1000.0).alias("start_s"), "text")),
    X.with_views(_S) + " SELECT job_id, ord, 'Speaker ' || CAST(coalesce(CASE WHEN ord % 3 <> 0 THEN speaker END, 0) AS VARCHAR) AS speaker, start_ms / 1000.0e0 AS start_s, text FROM sentences",
)
Q["C1_count_tokens"] = (
    _docs(lambda d: d.select("doc_id", T.count_tokens("text").alias("tokens"))),
    "SELECT doc_id, CAST(greatest(1, (length(text) + 3) // 4) AS BIGINT) AS tokens FROM documents",
)
_SQL_MD = "printf('[%.2f] %s: %s', start_ms / 1000.0e0, 'S' || CAST(speaker AS VARCHAR), text)"


def _named(s):
    return s.withColumn("name", F.concat(F.lit("S"), F.col("speaker").cast("string"))).withColumn("line", T.stamped_line("start_ms", "name", "text"))


Q["C2_sentence_markdown"] = (
    _sent(lambda s: R.ordered_join(_named(s), F.when(T.strip("text") != "", F.col("line")), "\n", "markdown")),
    X.with_views(_S) + " SELECT job_id, string_agg(" + _SQL_MD + ", chr(10) ORDER BY ord) AS markdown FROM sentences WHERE trim(text) <> '' GROUP BY job_id",
)
Q["C3_pack_sentences"] = (
    _sent(lambda s: R.pack_sentences(_named(s), 150).drop("first")),
    "WITH RECURSIVE " + _S + """, o AS (SELECT job_id, start_ms, end_ms, row_number() OVER (PARTITION BY job_id ORDER BY ord) - 1 AS i, count(*) OVER (PARTITION BY job_id) AS n,
      CASE WHEN trim(text) = '' THEN -1 ELSE length(""" + _SQL_MD + """) END AS z FROM sentences),
    p AS (SELECT job_id, i, n, start_ms, end_ms, z, sum(greatest(z, 0)) OVER w AS cz, sum(CASE WHEN z >= 0 THEN 1 ELSE 0 END) OVER w AS cn FROM o WINDOW w AS (PARTITION BY job_id ORDER BY i)),
    reach AS (SELECT a.job_id, a.i, a.n, coalesce(max(b.i) + 1, a.i) AS nxt FROM p a LEFT JOIN p b ON a.job_id = b.job_id AND b.i >= a.i AND
      greatest(1, (b.cz - coalesce((SELECT x.cz FROM p x WHERE x.job_id = a.job_id AND x.i = greatest(0, a.i - 3) - 1), 0)
        + greatest(0, b.cn - coalesce((SELECT x.cn FROM p x WHERE x.job_id = a.job_id AND x.i = greatest(0, a.i - 3) - 1), 0) - 1) + 3) // 4) <= 150 GROUP BY a.job_id, a.i, a.n),
    f AS (SELECT job_id, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS made FROM o WHERE i = 0
      UNION ALL SELECT f.job_id, CASE WHEN r.nxt > f.i THEN r.nxt ELSE f.i + 1 END, CASE WHEN r.nxt > f.i THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN r.nxt > f.i THEN f.i ELSE -1 END
      FROM f JOIN reach r ON r.job_id = f.job_id AND r.i = f.i WHERE f.i < r.n)
    SELECT f.job_id, f.chunk - 1 AS chunk, a.start_ms, b.end_ms, f.i - greatest(0, f.made - 3) AS n_sentences FROM f
    JOIN p a ON a.job_id = f.job_id AND a.i = greatest(0, f.made - 3) JOIN p b ON b.job_id = f.job_id AND b.i = f.i - 1 WHERE f.i > 0 AND f.made >= 0""",
)
Q["C7_representative_sample"] = (
    _docs(lambda d: d.select("doc_id", T.representative_sample("text", 400).alias("sample"))),
    """SELECT doc_id, CASE WHEN length(text) <= 400 THEN text ELSE left(text, 130) || chr(10) || '...' || chr(10) ||
      substr(text, CAST(greatest(0, length(text) // 2 - 65) + 1 AS INT), 130) || chr(10) || '...' || chr(10) || right(text, 130) END AS sample FROM documents""",
)
Q["C10_prompt_budgets"] = (
    _docs(lambda d: d.select("doc_id", F.greatest(F.lit(1), 8000 - F.length("text")).cast("long").alias("plan_budget"), F.least(F.lit(6000), F.greatest(F.lit(1), 8000 - F.length("text"))).cast("long").alias("write_budget"))),
    "SELECT doc_id, greatest(1, 8000 - length(text)) AS plan_budget, least(6000, greatest(1, 8000 - length(text))) AS write_budget FROM documents",
)
Q["C16_transcript_document"] = (
    _sent(lambda s: R.ordered_join(s, F.format_string("**[%02d:%02d] Speaker %d:** %s", F.floor(F.col("start_ms") / 60000), F.floor(F.col("start_ms") / 1000) % 60, F.col("speaker") + 1, F.col("text")), "\n\n", "document")),
    X.with_views(_S) + " SELECT job_id, string_agg(printf('**[%02d:%02d] Speaker %d:** %s', start_ms // 60000, start_ms // 1000 % 60, speaker + 1, text), chr(10) || chr(10) ORDER BY ord) AS document FROM sentences GROUP BY job_id",
)
# aggregates
Q["G2_full_text"] = (_sent(lambda s: R.ordered_join(s, F.col("text"), " ", "full_text")), X.with_views(_S) + " SELECT job_id, string_agg(text, ' ' ORDER BY ord) AS full_text FROM sentences GROUP BY job_id")
Q["G3_duration"] = (
    lambda spark, sf_dir: X.sentences(spark, sf_dir).groupBy("job_id").agg(F.greatest(F.max(F.when(F.col("ord") == 0, F.col("end_ms") * 3)), F.max("end_ms")).alias("duration_ms")),
    X.with_views(_S) + " SELECT job_id, greatest(max(CASE WHEN ord = 0 THEN end_ms * 3 END), max(end_ms)) AS duration_ms FROM sentences GROUP BY job_id",
)
Q["G4_profile_waveform"] = (
    lambda spark, sf_dir: X.embedded(spark, sf_dir).select("job_id", F.explode("embedding").alias("x")).select("job_id", F.col("x").cast("double").alias("x")).groupBy("job_id").agg(
        F.round(F.max(F.abs("x")), 6).alias("peak"), F.round(F.sqrt(F.avg(F.col("x") * F.col("x"))), 6).alias("rms"), F.round(F.avg("x"), 6).alias("dc"),
        F.round(F.avg((F.abs("x") >= 0.2).cast("double")), 6).alias("clip_ratio"), F.round(F.avg((F.abs("x") < 0.001).cast("double")), 6).alias("silence_ratio"),
    ),
    X.with_views(_E) + """, x AS (SELECT job_id, CAST(unnest(embedding) AS DOUBLE) AS x FROM embedded) SELECT job_id, round(max(abs(x)), 6) AS peak, round(sqrt(avg(x * x)), 6) AS rms, round(avg(x), 6) AS dc,
      round(avg(CAST(abs(x) >= 0.2e0 AS DOUBLE)), 6) AS clip_ratio, round(avg(CAST(abs(x) < 0.001e0 AS DOUBLE)), 6) AS silence_ratio FROM x GROUP BY job_id""",
)
_RMS = "fr AS (SELECT vec_id, job_id, dim // 8 AS frame, sqrt(avg(x * x)) AS rms FROM (SELECT vec_id, job_id, unnest(range(len(embedding))) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embedded) AS t GROUP BY vec_id, job_id, dim // 8)"


def _frame_rms(spark, sf_dir):
    return X.embedded(spark, sf_dir).select("vec_id", "job_id", F.posexplode("embedding").alias("dim", "x")).groupBy("vec_id", "job_id", F.expr("dim div 8").alias("frame")).agg(F.sqrt(F.avg(F.col("x").cast("double") * F.col("x").cast("double"))).alias("rms"))


Q["G5_frame_rms"] = (lambda spark, sf_dir: _frame_rms(spark, sf_dir).select("vec_id", "frame", F.round("rms", 6).alias("rms")), X.with_views(_E, _RMS) + " SELECT vec_id, frame, round(rms, 6) AS rms FROM fr")
Q["G6_snr_estimate"] = (
    lambda spark, sf_dir: _frame_rms(spark, sf_dir).groupBy("job_id").agg(F.percentile("rms", 0.2).alias("noise"), F.percentile("rms", 0.8).alias("speech")).select("job_id", F.round("noise", 6).alias("noise"), F.round("speech", 6).alias("speech"), F.round(F.when(F.col("speech") <= 0, 0.0).when(F.col("noise") <= 1e-8, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 20 * F.log10(F.col("speech") / F.col("noise"))))), 4).alias("snr_db")),
    X.with_views(_E, _RMS) + """, q AS (SELECT job_id, quantile_cont(rms, 0.2) AS noise, quantile_cont(rms, 0.8) AS speech FROM fr GROUP BY job_id)
    SELECT job_id, round(noise, 6) AS noise, round(speech, 6) AS speech, round(CASE WHEN speech <= 0 THEN 0.0e0 WHEN noise <= 1e-8 THEN 100.0e0 ELSE greatest(0.0e0, least(100.0e0, 20 * log10(speech / noise))) END, 4) AS snr_db FROM q""",
)
Q["G12_cluster_centroids"] = (
    _emb(lambda e: V.centroids(e).select(F.col("label"), F.col("dim").cast("long").alias("dim"), F.round("mean", 6).alias("mean"), "size")),
    "SELECT label, dim, round(avg(CAST(x AS DOUBLE)), 6) AS mean, count(*) AS size FROM (SELECT label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM embeddings) AS t GROUP BY label, dim",
)
Q["G13_done_event"] = (_sent(lambda s: s.groupBy("job_id").agg(F.count("*").alias("num_segments"), F.max("end_ms").alias("duration_ms"))), X.with_views(_S) + " SELECT job_id, count(*) AS num_segments, max(end_ms) AS duration_ms FROM sentences GROUP BY job_id")
Q["G14_vad_inspection"] = (
    lambda spark, sf_dir: X.vad(spark, sf_dir).select("job_id", "ord", F.bround(F.col("start_ms") / 1000.0, 3).alias("start_s"), F.bround((F.col("end_ms") - F.col("start_ms")) / 1000.0, 3).alias("duration_s"), F.count("*").over(W.partitionBy("job_id")).alias("num_segments")),
    X.with_views(_S, _V) + " SELECT job_id, ord, start_ms / 1000.0e0 AS start_s, (end_ms - start_ms) / 1000.0e0 AS duration_s, count(*) OVER (PARTITION BY job_id) AS num_segments FROM vad",
)
# windows and similarity
Q["W1_sentence_windows"] = (
    _sent(lambda s: R.sentence_windows(s.withColumn("name", F.when(F.col("speaker") > 0, F.concat(F.lit("S"), F.col("speaker").cast("string")))))),
    X.with_views(_S) + """, p AS (SELECT job_id, ord, start_ms, end_ms, coalesce(CASE WHEN speaker > 0 THEN 'S' || CAST(speaker AS VARCHAR) END, 'UNKNOWN') || ': ' || text AS said FROM sentences)
    SELECT * FROM (SELECT job_id, row_number() OVER w - 1 AS start_idx, start_ms, lead(end_ms, 2) OVER w AS end_ms, said || ' ' || lead(said) OVER w || ' ' || lead(said, 2) OVER w AS merged_text FROM p WINDOW w AS (PARTITION BY job_id ORDER BY ord)) AS t WHERE end_ms IS NOT NULL""",
)
_SIM = """p AS (SELECT job_id, ord, CAST(embedding AS DOUBLE[]) AS b, CAST(lag(embedding) OVER (PARTITION BY job_id ORDER BY ord) AS DOUBLE[]) AS a FROM embedded),
sims AS (SELECT job_id, ord, list_dot_product(a, b) / ((sqrt(list_dot_product(a, a)) + 1e-8) * (sqrt(list_dot_product(b, b)) + 1e-8)) AS sim FROM p WHERE a IS NOT NULL)"""
Q["W3_detect_boundaries"] = (
    _emb(lambda e: R.boundaries(e, 0.1)),
    X.with_views(_E, _SIM) + " SELECT job_id, ord AS boundary FROM sims WHERE sim < 0.1e0 UNION SELECT job_id, 0 FROM embedded UNION SELECT job_id, count(*) FROM embedded GROUP BY job_id",
)
Q["W4_smooth_similarities"] = (
    _emb(lambda e: R.smooth(e).select("job_id", "ord", F.round("ema", 6).alias("ema"))),
    "WITH RECURSIVE " + _E + "," + _SIM + """, r AS (SELECT job_id, ord, sim, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS rn FROM sims),
    f AS (SELECT job_id, rn, ord, sim AS ema FROM r WHERE rn = 1 UNION ALL SELECT r.job_id, r.rn, r.ord, 0.7e0 * r.sim + (1 - 0.7e0) * f.ema FROM f JOIN r ON r.job_id = f.job_id AND r.rn = f.rn + 1)
    SELECT job_id, ord, round(ema, 6) AS ema FROM f""",
)
Q["W5_adaptive_threshold"] = (
    _emb(lambda e: R.adaptive_threshold(R.consecutive_similarity(e).filter("sim is not null")).select("job_id", F.round("threshold", 6).alias("threshold"))),
    X.with_views(_E, _SIM) + " SELECT job_id, round(avg(sim) - 0.5e0 * stddev_pop(sim), 6) AS threshold FROM sims GROUP BY job_id",
)
Q["W7_stack_frames"] = (
    _emb(lambda e: R.stack_frames(e.select(F.col("job_id").alias("key"), F.col("ord").alias("t"), F.slice("embedding", 1, 2).alias("v"))).select("key", "i", F.posexplode("v").alias("pos", "x")).select("key", "i", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"))),
    X.with_views(_E) + """, n AS (SELECT job_id, count(*) AS total FROM embedded GROUP BY job_id),
    h AS (SELECT job_id, total, unnest(range((total + 5) // 6)) AS i FROM n), k AS (SELECT job_id, total, i, unnest(range(7)) AS k FROM h),
    w AS (SELECT job_id, i, k, greatest(0, least(total - 1, i * 6 - 3 + k)) AS t FROM k)
    SELECT w.job_id AS key, i, k * 2 + d AS pos, CAST(embedding[CAST(d + 1 AS INT)] AS DOUBLE) AS x FROM w JOIN embedded e ON e.job_id = w.job_id AND e.ord = w.t CROSS JOIN (SELECT unnest(range(2)) AS d) AS q""",
)
# ranking, sets, logs
Q["L1_page_of_meetings"] = (
    lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/orders.parquet").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(40).limit(20).select("o_orderkey"),
    "SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
)
Q["L3_latest_event"] = (_ev(lambda e: e.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))), "SELECT user_id, max_by(event_id, row(ts, event_id)) AS latest FROM events GROUP BY user_id")
Q["U3_replay_union"] = (
    _sent(lambda s: s.select("job_id", F.lit(1).alias("part"), F.col("ord").alias("seq"), F.lit("segment").alias("kind")).unionByName(s.groupBy("job_id").agg(F.count("*").alias("seq")).select("job_id", F.lit(2).alias("part"), "seq", F.lit("done").alias("kind"))).unionByName(s.select("job_id").distinct().select("job_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq"), F.lit("status").alias("kind")))),
    X.with_views(_S) + " SELECT job_id, 1 AS part, ord AS seq, 'segment' AS kind FROM sentences UNION ALL SELECT job_id, 2, count(*), 'done' FROM sentences GROUP BY job_id UNION ALL SELECT DISTINCT job_id, 0, CAST(0 AS BIGINT), 'status' FROM sentences",
)
_LOG = """lg AS (SELECT user_id % 40 AS session_id, event_id AS seq, CASE WHEN event_type IN ('click', 'purchase') THEN 'delta' ELSE 'partial' END AS kind, (event_id * 37) % 500 * 10 AS start_ms, (event_id * 37) % 500 * 10 + 50 + event_id % 90 AS end_ms FROM events)"""
Q["T12_reduce_transcripts"] = (
    _ev(lambda e: R.reduce_transcripts(e.selectExpr("user_id % 40 AS session_id", "event_id AS seq", "CASE WHEN event_type IN ('click', 'purchase') THEN 'delta' ELSE 'partial' END AS kind", "(event_id * 37) % 500 * 10 AS start_ms", "(event_id * 37) % 500 * 10 + 50 + event_id % 90 AS end_ms"))),
    "WITH " + _LOG + """, d AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY session_id, start_ms ORDER BY seq DESC) AS rn FROM lg WHERE kind = 'delta') AS t WHERE rn = 1),
    p AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY session_id, start_ms ORDER BY end_ms DESC, seq DESC) AS rn FROM lg WHERE kind = 'partial') AS t WHERE rn = 1)
    SELECT * FROM d UNION ALL SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.session_id = p.session_id AND d.start_ms BETWEEN p.start_ms AND p.end_ms)""",
)
Q["T14_last_events_per_subscriber"] = (
    _ev(lambda e: R.best_versions(e, ["user_id"], [F.desc("ts"), F.desc("event_id")]).filter("rn <= 20").select("user_id", "event_id", "rn")),
    "SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) AS t WHERE rn <= 20",
)
Q["T21_event_sessions"] = (
    _ev(lambda e: R.sessionize(e, "user_id", "ts", 6 * 3600).groupBy("user_id", "session").agg(F.count("*").alias("n"))),
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS f FROM events),
    s AS (SELECT user_id, CAST(sum(f) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session FROM g) SELECT user_id, session, count(*) AS n FROM s GROUP BY user_id, session""",
)
# vectors
_PAIRS = """pr AS (SELECT a.job_id, a.ord AS i, b.ord AS j, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embedded a JOIN embedded b ON a.job_id = b.job_id),
sm AS (SELECT job_id, i, j, list_dot_product(x, y) / ((sqrt(list_dot_product(x, x)) + 1e-8) * (sqrt(list_dot_product(y, y)) + 1e-8)) AS sim FROM pr)"""
Q["E1_similarity_matrix"] = (_emb(lambda e: V.similarity_pairs(e).select("job_id", "i", "j", F.round("sim", 6).alias("sim"))), X.with_views(_E, _PAIRS) + " SELECT job_id, i, j, round(sim, 6) AS sim FROM sm")
_PRUNE = """pn AS (SELECT job_id, i, j, CASE WHEN row_number() OVER (PARTITION BY job_id, i ORDER BY sim, j) <= least(CAST(floor((1 - 0.012e0) * count(*) OVER (PARTITION BY job_id, i)) AS BIGINT), count(*) OVER (PARTITION BY job_id, i) - 6) THEN 0.0e0 ELSE sim END AS sim FROM sm)"""
Q["E2_prune_similarities"] = (_emb(lambda e: V.prune(V.similarity_pairs(e)).select("job_id", "i", "j", F.round("sim", 6).alias("sim"))), X.with_views(_E, _PAIRS, _PRUNE) + " SELECT job_id, i, j, round(sim, 6) AS sim FROM pn")
Q["E3_laplacian"] = (
    _emb(lambda e: V.laplacian(V.prune(V.similarity_pairs(e))).select("job_id", "i", "j", F.round(F.col("value") + 0.0, 6).alias("value"))),
    X.with_views(_E, _PAIRS, _PRUNE) + """, m AS (SELECT a.job_id, a.i, a.j, CASE WHEN a.i = a.j THEN 0.0e0 ELSE 0.5e0 * (a.sim + b.sim) END AS m FROM pn a JOIN pn b ON a.job_id = b.job_id AND a.i = b.j AND a.j = b.i)
    SELECT job_id, i, j, round(CASE WHEN i = j THEN sum(abs(m)) OVER (PARTITION BY job_id, i) ELSE -m END + 0.0e0, 6) AS value FROM m""",
)
Q["E6_reassign_minor_clusters"] = (
    _emb(lambda e: V.reassign_minor(e, 4)),
    X.with_views(_E) + """, z AS (SELECT job_id, label, count(*) AS size FROM embedded GROUP BY job_id, label),
    r AS (SELECT e.*, size FROM embedded e JOIN z USING (job_id, label)),
    c AS (SELECT job_id, label, list(m ORDER BY dim) AS c FROM (SELECT job_id, label, dim, avg(CAST(x AS DOUBLE)) AS m FROM (SELECT job_id, label, unnest(range(len(embedding))) AS dim, unnest(embedding) AS x FROM r WHERE size > 4) AS u GROUP BY job_id, label, dim) AS v GROUP BY job_id, label),
    n AS (SELECT r.job_id, r.vec_id, c.label AS new_label, row_number() OVER (PARTITION BY r.job_id, r.vec_id ORDER BY list_dot_product(CAST(embedding AS DOUBLE[]), c) / ((sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) + 1e-8) * (sqrt(list_dot_product(c, c)) + 1e-8)) DESC, c.label) AS rn FROM r JOIN c ON r.job_id = c.job_id WHERE r.size <= 4)
    SELECT r.job_id, r.vec_id, coalesce(n.new_label, r.label) AS label FROM r LEFT JOIN n ON r.job_id = n.job_id AND r.vec_id = n.vec_id AND n.rn = 1""",
)
