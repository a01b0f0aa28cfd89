"""Queries over stored records, metrics and documents, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audio as A
from ..operators import diarize as N
from ..operators import documents as D
from ..operators import finalize as Z
from ..operators import records as R
from ..operators import transcripts as P
from ..operators import vectors as V
from ..sources import media as M
from ..streaming import sessions as L
from . import fixtures as X
from . import transcript_queries as tq
from .interval_queries import _DUR, _I15, _J6, _OV, _PLAN, _SPK

_S, _D, _V = X.SENTENCES, X.DIAR, X.VAD
Q = {}


def _sent(fn):
    return lambda spark, sf_dir: fn(X.sentences(spark, sf_dir))


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# persistence
def _report(spark, sf_dir):
    s = X.sentences(spark, sf_dir)
    said = F.transform(F.sort_array(F.collect_list(F.struct("ord", "speaker", "text"))), lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text")))
    tasks = F.sort_array(F.collect_list(F.when(F.col("ord") % 3 == 0, F.struct(F.concat(F.lit("task "), F.col("ord").cast("string")).alias("task")))))
    return s.groupBy(F.col("job_id").alias("meeting_id")).agg(F.max("end_ms").alias("duration_ms"), said.alias("sentences"), tasks.alias("actions"))


def _k1(spark, sf_dir):
    tables = R.report_tables(_report(spark, sf_dir), ["sentences", "actions"])
    row = lambda name, value: tables[name].select(F.lit(name).alias("table"), "meeting_id", "place", value.alias("value"))
    meetings = tables["meetings"].select(F.lit("meetings").alias("table"), "meeting_id", F.lit(0).cast("long").alias("place"), F.col("duration_ms").cast("string").alias("value"))
    return meetings.unionByName(row("sentences", F.col("text"))).unionByName(row("actions", F.col("task")))


Q["K1_report_tables"] = (
    _k1,
    X.with_views(_S) + """ SELECT 'meetings' AS "table", job_id AS meeting_id, CAST(0 AS BIGINT) AS place, CAST(max(end_ms) AS VARCHAR) AS value FROM sentences GROUP BY job_id
    UNION ALL SELECT 'sentences', job_id, row_number() OVER (PARTITION BY job_id ORDER BY ord) - 1, text FROM sentences
    UNION ALL SELECT 'actions', job_id, row_number() OVER (PARTITION BY job_id ORDER BY 'task ' || CAST(ord AS VARCHAR)) - 1, 'task ' || CAST(ord AS VARCHAR) FROM sentences WHERE ord % 3 = 0""",
)
Q["K3_update_by_id"] = (
    _sent(lambda s: R.update_by_id(s.select("job_id", "ord", "speaker"), s.filter("job_id % 4 <> 0 or ord % 5 <> 2").select("job_id", "ord", (F.col("speaker") + 5).alias("speaker")), "ord", "speaker")),
    X.with_views(_S) + """, bad AS (SELECT DISTINCT job_id FROM sentences WHERE job_id % 4 = 0 AND ord % 5 = 2)
    SELECT job_id, ord, CASE WHEN job_id IN (SELECT job_id FROM bad) THEN speaker ELSE speaker + 5 END AS speaker, job_id NOT IN (SELECT job_id FROM bad) AS applied FROM sentences""",
)


def _outputs(s):
    half = F.explode(F.when(F.col("ord") % 3 == 1, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("place")
    rows = s.select("job_id", "ord", "start_ms", "end_ms", "speaker", "text", half)
    mid = F.expr("(start_ms + end_ms) div 2")
    start = F.when((F.col("ord") % 3 == 1) & (F.col("place") == 1), mid).otherwise(F.col("start_ms") - 40)
    end = F.when((F.col("ord") % 3 == 1) & (F.col("place") == 0), mid).otherwise(F.col("end_ms") + 70)
    text = F.when((F.col("job_id") % 6 == 0) & (F.col("ord") == 1), " ").otherwise(F.concat(F.lit(" "), "text"))
    return rows.select("job_id", "ord", "place", (start / 1000.0).alias("start_s"), (end / 1000.0).alias("end_s"), (F.col("speaker") + F.col("place") + 1).alias("speaker"), text.alias("text"), (F.col("ord") % 3 == 1).alias("replaced"))


Q["K4_replace_segments"] = (
    _sent(lambda s: R.replace_segments(s.select("job_id", "ord", "start_ms", "end_ms", "speaker", "text"), _outputs(s)).drop("text")),
    X.with_views(_S) + """, bad AS (SELECT job_id FROM sentences WHERE (job_id % 6 = 0 AND ord = 1) OR (ord % 3 = 1 AND (start_ms + end_ms) // 2 <= start_ms))
    SELECT job_id, ord, start_ms, end_ms, speaker, 'kept' AS origin, FALSE AS applied FROM sentences WHERE job_id IN (SELECT job_id FROM bad)
    UNION ALL SELECT job_id, ord, start_ms, end_ms, speaker + 1, 'kept', TRUE FROM sentences WHERE ord % 3 <> 1 AND job_id NOT IN (SELECT job_id FROM bad)
    UNION ALL SELECT job_id, ord, start_ms, (start_ms + end_ms) // 2, speaker + 1, 'new', TRUE FROM sentences WHERE ord % 3 = 1 AND job_id NOT IN (SELECT job_id FROM bad)
    UNION ALL SELECT job_id, ord, (start_ms + end_ms) // 2, end_ms, speaker + 2, 'new', TRUE FROM sentences WHERE ord % 3 = 1 AND job_id NOT IN (SELECT job_id FROM bad)""",
)
Q["K6_upsert_live_document"] = (
    lambda spark, sf_dir: R.upsert(
        *(X.events(spark, sf_dir).filter(f"event_id % 3 {c}").groupBy("user_id", F.col("event_type").alias("mode")).agg(F.max("event_id").alias("version"), F.max_by("value", "event_id").alias("document")) for c in ("= 0", "<> 0")), ["user_id", "mode"], "version"),
    "SELECT user_id, event_type AS mode, max(event_id) AS version, max_by(value, event_id) AS document FROM events GROUP BY user_id, event_type",
)
Q["J13_meeting_report"] = (
    lambda spark, sf_dir: R.report(
        _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("meeting_id")),
        {"orders": _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("meeting_id"), F.col("o_orderkey").alias("place"), F.col("o_orderstatus").alias("status")),
         "events": X.events(spark, sf_dir).select(F.col("user_id").alias("meeting_id"), F.col("event_id").alias("place"), F.col("event_type").alias("kind"))},
    ).select("meeting_id", F.array_join(F.transform("orders", lambda x: F.concat(x["place"].cast("string"), x["status"])), ",").alias("orders"), F.array_join(F.transform("events", lambda x: F.concat(x["place"].cast("string"), x["kind"])), ",").alias("events")),
    """SELECT c_custkey AS meeting_id, coalesce(o, '') AS orders, coalesce(e, '') AS events FROM customer
    LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR) || o_orderstatus, ',' ORDER BY o_orderkey) AS o FROM orders GROUP BY o_custkey) AS a ON c_custkey = o_custkey
    LEFT JOIN (SELECT user_id, string_agg(CAST(event_id AS VARCHAR) || event_type, ',' ORDER BY event_id) AS e FROM events GROUP BY user_id) AS b ON c_custkey = user_id""",
)
_ACTIONS = "act AS (SELECT job_id, ord, 'task ' || CAST(ord AS VARCHAR) AS task, CASE WHEN ord % 4 = 0 THEN 'An' ELSE '' END AS assignee, CASE ord % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'urgent' END AS priority FROM sentences WHERE (job_id + ord) % 4 = 0)"
_HUMAN = "CASE WHEN {0} >= 3600000 THEN printf('%d:%02d:%02d', {0} // 3600000, {0} % 3600000 // 60000, {0} // 1000 % 60) ELSE printf('%02d:%02d', {0} // 60000, {0} // 1000 % 60) END"
Q["K10_markdown_report"] = (
    _sent(lambda s: D.meeting_markdown(
        s.groupBy("job_id").agg(F.max("end_ms").alias("duration_ms"), F.when(F.col("job_id") % 2 == 0, F.lit("Short.")).alias("summary")), s,
        s.filter("(job_id + ord) % 4 = 0").selectExpr("job_id", "ord", "'task ' || CAST(ord AS STRING) AS task", "CASE WHEN ord % 4 = 0 THEN 'An' ELSE '' END AS assignee", "CASE ord % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'low' ELSE 'urgent' END AS priority"))),
    X.with_views(_S, _ACTIONS) + f""", todo AS (SELECT job_id, string_agg('| ' || CAST(n AS VARCHAR) || ' | ' || task || ' | ' || CASE WHEN assignee = '' THEN '-' ELSE assignee END || ' | ' || CASE priority WHEN 'high' THEN '🔴 Cao' WHEN 'low' THEN '🟢 Thấp' ELSE priority END || ' |', chr(10) ORDER BY ord) AS t
      FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS n FROM act) AS z GROUP BY job_id),
    said AS (SELECT job_id, max(end_ms) AS d, string_agg('`[' || {_HUMAN.format('start_ms')} || ' → ' || {_HUMAN.format('end_ms')} || ']` Speaker ' || CAST(speaker AS VARCHAR) || ': ' || text || '  ', chr(10) ORDER BY ord) AS s FROM sentences GROUP BY job_id)
    SELECT said.job_id, '# Báo cáo Cuộc họp' || chr(10) || chr(10) || '**Thời lượng:** ' || {_HUMAN.format('d')} || '  ' || CASE WHEN said.job_id % 2 = 0 THEN chr(10) || chr(10) || '## Tóm tắt' || chr(10) || chr(10) || 'Short.' ELSE '' END
      || coalesce(chr(10) || chr(10) || '## Action Items' || chr(10) || chr(10) || '| # | Công việc | Người phụ trách | Ưu tiên |' || chr(10) || '|---|---|---|---|' || chr(10) || t, '') || chr(10) || chr(10) || '## Transcript' || chr(10) || chr(10) || s AS report FROM said LEFT JOIN todo USING (job_id)""",
)
Q["L2_sources_of_user"] = (
    lambda spark, sf_dir: _table(spark, sf_dir, "orders").filter("o_custkey = 7").orderBy(F.desc("o_orderdate"), "o_orderkey").select("o_orderkey", "o_orderstatus"),
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 7 ORDER BY o_orderdate DESC, o_orderkey",
)
Q["S10_point_read"] = (lambda spark, sf_dir: _table(spark, sf_dir, "customer").filter("c_custkey = 11").select("c_custkey", "c_name"), "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 11")


# sources
Q["S5_scp_list"] = (
    _sent(lambda s: M.scp_entries(s.select("job_id", "ord", "text"), "text").drop("text")),
    X.with_views(_S) + r" SELECT * FROM (SELECT job_id, ord, regexp_extract(trim(text), '^(\S+)\s+(.*)$', 1) AS key, regexp_extract(trim(text), '^(\S+)\s+(.*)$', 2) AS path FROM sentences) AS t WHERE key <> ''",
)
Q["S7_jsonl_skip_malformed"] = (
    lambda spark, sf_dir: M.json_entries(X.events(spark, sf_dir).selectExpr("event_id", "CASE WHEN event_id % 5 = 0 THEN concat('[', props) WHEN event_id % 7 = 0 THEN ' ' ELSE props END AS line"), "line", "k bigint").drop("line"),
    "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0",
)
Q["S8_pad_batch"] = (
    lambda spark, sf_dir: M.pad_batch(X.embedded(spark, sf_dir).select("vec_id", "job_id", F.slice("embedding", 1, F.expr("cast(3 + vec_id % 5 as int)")).alias("x")), "job_id", "x").select("vec_id", "length", F.posexplode("padded").alias("pos", "v")).selectExpr("vec_id", "cast(length as bigint) AS length", "cast(pos as bigint) AS pos", "cast(v as double) AS v"),
    X.with_views(X.EMBEDDED) + """, l AS (SELECT vec_id, job_id, embedding, 3 + vec_id % 5 AS length, max(3 + vec_id % 5) OVER (PARTITION BY job_id) AS most FROM embedded)
    SELECT vec_id, length, pos, CASE WHEN pos < length THEN CAST(embedding[CAST(pos + 1 AS INT)] AS DOUBLE) ELSE 0.0e0 END AS v FROM (SELECT *, unnest(range(CAST(most AS BIGINT))) AS pos FROM l) AS t""",
)
Q["S9_pcm_to_float"] = (
    lambda spark, sf_dir: X.events(spark, sf_dir).select("event_id", F.posexplode(M.pcm_to_float(F.unhex(F.lpad(F.hex("event_id"), 8, "0")))).alias("pos", "x")).select("event_id", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x")),
    """SELECT event_id, pos, CASE WHEN u >= 32768 THEN u - 65536 ELSE u END / 32768.0e0 AS x
    FROM (SELECT event_id, pos, (event_id >> CAST(24 - 16 * pos AS INT)) % 256 + (event_id >> CAST(16 - 16 * pos AS INT)) % 256 * 256 AS u FROM (SELECT event_id, unnest(range(2)) AS pos FROM events) AS p) AS t""",
)


# projections
_RESULTS = """res AS (SELECT job_id, ord, CASE WHEN ord % 6 = 5 THEN '  ' ELSE ' ' || text END AS text, ord % 2 = 0 AND length(text) > 0 AS timed, length(text) AS n FROM sentences),
seg AS (SELECT job_id, ord, start_ms, end_ms, 1000 AS offset_ms FROM vad)"""


def _results(s):
    ts = F.when((F.col("ord") % 2 == 0) & (F.length("text") > 0), F.transform(F.sequence(F.lit(0), F.length("text") - 1), lambda k: F.struct((k * 10).cast("long").alias("s"), (k * 10 + 10).cast("long").alias("e"))))
    return s.select("job_id", "ord", F.when(F.col("ord") % 6 == 5, "  ").otherwise(F.concat(F.lit(" "), "text")).alias("text"), F.coalesce(ts, F.array().cast("array<struct<s:bigint,e:bigint>>")).alias("ts"))


Q["P2_build_sentence_info"] = (
    lambda spark, sf_dir: R.pair_results(_results(X.sentences(spark, sf_dir)), X.vad(spark, sf_dir).withColumn("offset_ms", F.lit(1000).cast("long"))),
    X.with_views(_S, _V, _RESULTS) + r""", a AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS k FROM res), b AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord) AS k FROM seg)
    SELECT a.job_id, k - 1 AS ord, 1000 + CASE WHEN timed THEN 0 ELSE start_ms END AS start_ms, 1000 + CASE WHEN timed THEN n * 10 ELSE end_ms END AS end_ms, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM a JOIN b USING (job_id, k) WHERE trim(text) <> ''""",
)
Q["P8_fallback_segment"] = (
    _sent(lambda s: R.fallback_segment(s.groupBy("job_id").agg(F.when(F.col("job_id") % 5 == 0, F.lit(" whole text ")).otherwise("").alias("text"), F.max("end_ms").alias("duration_ms")), s.withColumn("text", F.when(F.col("job_id") % 5 < 2, " ").otherwise(F.col("text"))))),
    X.with_views(_S) + """ SELECT job_id, ord, start_ms, end_ms, speaker, text FROM sentences WHERE job_id % 5 >= 2 AND trim(text) <> ''
    UNION ALL SELECT job_id, 0, 0, max(end_ms), NULL, 'whole text' FROM sentences WHERE job_id % 5 = 0 GROUP BY job_id""",
)
Q["P9_derived_status"] = (
    lambda spark, sf_dir: R.source_status(
        _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("source_id")),
        _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source_id")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("s")).select("source_id", F.when(F.col("s") == "F", "done").when(F.col("s") == "P", "failed").otherwise("queued").alias("status")),
        X.events(spark, sf_dir).select(F.col("user_id").alias("source_id"), F.when(F.col("event_type") == "click", "live").otherwise(F.col("event_type")).alias("mode"), F.when(F.col("event_id") % 3 == 0, " ").otherwise("text").alias("markdown"))),
    """WITH j AS (SELECT o_custkey, max_by(o_orderstatus, row(o_orderdate, o_orderkey)) AS s FROM orders GROUP BY o_custkey),
    d AS (SELECT user_id, string_agg(event_type, ',' ORDER BY event_type) FILTER (WHERE event_type <> 'click') AS docs, count(*) AS n FROM events WHERE event_type = 'click' OR event_id % 3 <> 0 GROUP BY user_id)
    SELECT c_custkey AS source_id, CASE WHEN s IS NULL OR s = 'P' THEN 'failed' WHEN s = 'F' THEN 'done' ELSE 'processing' END AS status, coalesce(docs, '') AS docs, coalesce(n, 0) AS n_visible
    FROM customer LEFT JOIN j ON c_custkey = o_custkey LEFT JOIN d ON c_custkey = user_id""",
)
Q["P11_payload_errors"] = (
    _sent(lambda s: R.payload_errors(s.selectExpr("job_id", "ord", "start_ms - 200 * (ord % 4) AS start_ms", "CASE WHEN ord % 5 = 1 THEN start_ms - 900 ELSE end_ms END AS end_ms", "CASE WHEN ord % 3 = 0 THEN -1 ELSE speaker END AS speaker"))),
    X.with_views(_S) + """, m AS (SELECT job_id, ord, start_ms - 200 * (ord % 4) AS s, CASE WHEN ord % 5 = 1 THEN start_ms - 900 ELSE end_ms END AS e, CASE WHEN ord % 3 = 0 THEN -1 ELSE speaker END AS p FROM sentences)
    SELECT job_id, ord, 'end_before_start' AS rule FROM m WHERE e < s UNION ALL SELECT job_id, ord, 'start_negative' FROM m WHERE s < 0 UNION ALL SELECT job_id, ord, 'speaker_negative' FROM m WHERE p < 0""",
)
Q["P13_media_type_rule"] = (
    lambda spark, sf_dir: _table(spark, sf_dir, "pages").withColumn("type", F.when(F.col("page_id") % 3 == 0, "video/mp4").when(F.col("page_id") % 3 == 1, "audio/wav")).withColumn("name", F.concat("url", F.when(F.col("page_id") % 4 == 0, ".MOV").otherwise(".wav"))).select("page_id", R.media_type("type", "name").alias("media")),
    "SELECT page_id, CASE WHEN page_id % 3 = 0 OR page_id % 4 = 0 THEN 'video' ELSE 'audio' END AS media FROM pages",
)
Q["I20_payload_rows"] = (
    _sent(lambda s: Z.payload_rows(s.withColumns({"start_s": F.col("start_ms") / 1000.0 - F.col("ord") % 2, "end_s": F.col("end_ms") / 1000.0 - 3.0 * (F.col("ord") % 3)}))),
    X.with_views(_S) + r""", m AS (SELECT *, greatest(0, CAST(trunc((start_ms / 1000.0e0 - ord % 2) * 1000) AS BIGINT)) AS a, CAST(trunc((end_ms / 1000.0e0 - 3.0e0 * (ord % 3)) * 1000) AS BIGINT) AS b FROM sentences)
    SELECT job_id, ord, a AS start_ms, greatest(a, b) AS end_ms, speaker, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM m""",
)
_INSIDE = """rng AS (SELECT job_id, start_ms, end_ms FROM vad WHERE job_id % 3 <> 0 UNION ALL SELECT job_id, 0, max(end_ms) FROM sentences WHERE job_id NOT IN (SELECT job_id FROM vad WHERE job_id % 3 <> 0) GROUP BY job_id),
diar AS (SELECT d.job_id, d.seg_ord, greatest(d.start_ms, r.start_ms) AS start_ms, least(d.end_ms, r.end_ms) AS end_ms, d.speaker FROM diar0 d JOIN rng r ON d.job_id = r.job_id AND d.start_ms < r.end_ms AND r.start_ms < d.end_ms)"""
Q["I22_prepare_retranscription"] = (
    lambda spark, sf_dir: Z.prepare_retranscription(
        X.sentences(spark, sf_dir), X.diar(spark, sf_dir),
        Z.refreshed_ranges(X.vad(spark, sf_dir).filter("job_id % 3 <> 0").select("job_id", "start_ms", "end_ms"), X.sentences(spark, sf_dir).groupBy("job_id").agg(F.lit(0).cast("long").alias("start_ms"), F.max("end_ms").alias("end_ms")))).select("job_id", "ord", "action"),
    X.with_views(_S, _D.replace("diar AS (", "diar0 AS ("), _V, _INSIDE, _DUR, _OV, _SPK, _I15, _J6, _PLAN) + " SELECT job_id, ord, action FROM plan",
)


# joins and sets
Q["J10_as_of_playback"] = (
    _sent(lambda s: R.playing_segment(s.select("job_id", F.explode(F.array(F.col("start_ms") + 5, F.col("end_ms") + 120, F.col("end_ms") + 5000)).alias("at_ms")).distinct(), s.select("job_id", "ord", "start_ms", (F.col("end_ms") - 100).alias("end_ms")))),
    X.with_views(_S) + """, t AS (SELECT DISTINCT job_id, unnest([start_ms + 5, end_ms + 120, end_ms + 5000]) AS at_ms FROM sentences),
    g AS (SELECT job_id, ord, start_ms, greatest(end_ms - 100, coalesce(lead(start_ms) OVER (PARTITION BY job_id ORDER BY start_ms, ord), end_ms - 100)) AS until FROM sentences),
    l AS (SELECT job_id, start_ms, max(row(ord, until)) AS s FROM g GROUP BY job_id, start_ms)
    SELECT t.job_id, at_ms, CASE WHEN at_ms <= s[2] THEN s[1] END AS ord FROM t ASOF LEFT JOIN l ON t.job_id = l.job_id AND t.at_ms >= l.start_ms""",
)
Q["J15_confirmed_in_partial"] = (
    lambda spark, sf_dir: R.covered_partials(X.vad(spark, sf_dir).select("job_id", "ord", "start_ms", "end_ms"), X.sentences(spark, sf_dir).filter("ord % 2 = 0").select("job_id", "start_ms")),
    X.with_views(_S, _V) + " SELECT job_id, ord FROM vad v WHERE EXISTS (SELECT 1 FROM sentences s WHERE s.job_id = v.job_id AND s.ord % 2 = 0 AND s.start_ms BETWEEN v.start_ms AND v.end_ms)",
)
Q["J9_merge_rescued_sentences"] = (
    lambda spark, sf_dir: Z.rescued(X.sentences(spark, sf_dir), _rescues(X.sentences(spark, sf_dir))).select("job_id", "ord", "start_ms", "end_ms", "text"),
    "WITH RECURSIVE " + _S + r""", c AS (SELECT s.job_id, s.ord * 2 + k AS ord, s.end_ms + k * 60 AS start_ms, s.end_ms + k * 60 + (s.ord * 131) % 400 + 20 AS end_ms, CASE WHEN (s.ord + k) % 5 = 0 THEN '  ' || text || ' ' ELSE 'extra ' || CAST((s.ord + k) % 7 AS VARCHAR) || ' ' || regexp_extract(coalesce(lead(text) OVER (PARTITION BY job_id, k ORDER BY ord), 'end'), '\S+') END AS text
      FROM sentences s CROSS JOIN (SELECT unnest([0, 1]) AS k) AS q),
    f AS (SELECT c.*, (SELECT row(n.start_ms, n.text) FROM sentences n WHERE n.job_id = c.job_id AND n.start_ms >= c.end_ms ORDER BY n.start_ms, n.end_ms LIMIT 1) AS nx FROM c),
    t AS (SELECT job_id, ord, start_ms, end_ms, CASE WHEN nx[1] - end_ms <= 250 AND lower(regexp_replace(regexp_extract(text, '\S+\s*$'), '[^\pL\pN_]+', '', 'g')) = lower(regexp_replace(regexp_extract(nx[2], '\S+'), '[^\pL\pN_]+', '', 'g')) THEN regexp_replace(regexp_replace(text, '\S+\s*$', ''), '\s+$', '') ELSE text END AS text FROM f),
    n AS (SELECT *, lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS norm FROM t),
    g AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms, ord) AS rn FROM n WHERE norm <> '' AND NOT EXISTS (SELECT 1 FROM sentences s WHERE s.job_id = n.job_id AND ((s.start_ms < n.end_ms AND n.start_ms < s.end_ms) OR lower(regexp_replace(regexp_replace(s.text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) = n.norm))),
    r AS (SELECT job_id, rn, ord, TRUE AS taken, end_ms AS until, [norm] AS norms FROM g WHERE rn = 1 UNION ALL
      SELECT g.job_id, g.rn, g.ord, g.start_ms >= r.until AND NOT list_contains(r.norms, g.norm), CASE WHEN g.start_ms >= r.until AND NOT list_contains(r.norms, g.norm) THEN greatest(r.until, g.end_ms) ELSE r.until END,
        CASE WHEN g.start_ms >= r.until AND NOT list_contains(r.norms, g.norm) THEN list_append(r.norms, g.norm) ELSE r.norms END FROM r JOIN g ON g.job_id = r.job_id AND g.rn = r.rn + 1)
    SELECT g.job_id, g.ord, g.start_ms, g.end_ms, g.text FROM g JOIN r ON g.job_id = r.job_id AND g.rn = r.rn WHERE taken""",
)


def _rescues(s):
    from pyspark.sql import Window as W

    two = s.select("job_id", "ord", "end_ms", "text", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    head = F.regexp_extract(F.coalesce(F.lead("text").over(W.partitionBy("job_id", "k").orderBy("ord")), F.lit("end")), r"\S+", 0)
    text = F.when((F.col("ord") + F.col("k")) % 5 == 0, F.concat(F.lit("  "), "text", F.lit(" "))).otherwise(F.concat(F.lit("extra "), ((F.col("ord") + F.col("k")) % 7).cast("string"), F.lit(" "), head))
    start = F.col("end_ms") + F.col("k") * 60
    return two.select("job_id", (F.col("ord") * 2 + F.col("k")).alias("ord"), start.alias("start_ms"), (start + F.expr("(ord * 131) % 400") + 20).alias("end_ms"), text.alias("text"))


Q["U2_coverage_set_equality"] = (
    lambda spark, sf_dir: R.same_members(X.sentences(spark, sf_dir), X.sentences(spark, sf_dir).filter("job_id % 3 <> 0 or ord % 4 <> 1"), ["ord"], "job_id"),
    X.with_views(_S) + " SELECT job_id, coalesce(count(*) FILTER (WHERE job_id % 3 = 0 AND ord % 4 = 1), 0) = 0 AS same FROM sentences GROUP BY job_id",
)
Q["U5_unsupported_options"] = (
    lambda spark, sf_dir: X.events(spark, sf_dir).select("event_id", F.array_join(F.array_sort(F.array_except(F.json_object_keys("props"), F.array(F.lit("a"), F.lit("b")))), ",").alias("unsupported")),
    "SELECT event_id, array_to_string(list_sort(list_filter(json_keys(props), lambda x: x NOT IN ('a', 'b'))), ',') AS unsupported FROM events",
)


# metrics
_REQ = """req AS (SELECT user_id % 20 AS coordinator, event_type AS kind, event_id * 10 AS submitted_ms, event_id * 10 + (event_id * 37) % 4000 AS started_ms, event_id * 10 + (event_id * 37) % 4000 + 50 + event_id % 900 AS ended_ms,
  CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 13 = 0 THEN 'dropped' ELSE 'completed' END AS outcome FROM events)"""


def _requests(spark, sf_dir):
    return spark.sql("WITH " + _REQ.replace("FROM events", "FROM {events}") + " SELECT * FROM req", events=X.events(spark, sf_dir))


Q["G7_coordinator_metrics"] = (
    lambda spark, sf_dir: R.inference_metrics(_requests(spark, sf_dir)).withColumns({"average_wait_ms": F.round("average_wait_ms", 6), "average_run_ms": F.round("average_run_ms", 6)}),
    "WITH " + _REQ + """, s AS (SELECT coordinator, t, d, sum(d) AS step FROM (SELECT coordinator, submitted_ms AS t, 1 AS d FROM req WHERE outcome <> 'dropped' UNION ALL SELECT coordinator, started_ms, -1 FROM req WHERE outcome <> 'dropped') AS z GROUP BY coordinator, t, d),
    q AS (SELECT coordinator, CAST(greatest(max(depth), 0) AS BIGINT) AS max_depth FROM (SELECT coordinator, sum(step) OVER (PARTITION BY coordinator ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS depth FROM s) AS y GROUP BY coordinator)
    SELECT coordinator, count(*) FILTER (WHERE outcome = 'completed') AS completed, count(*) FILTER (WHERE outcome = 'failed') AS failed, count(*) FILTER (WHERE outcome = 'dropped') AS dropped,
      round(coalesce(avg(started_ms - submitted_ms) FILTER (WHERE outcome <> 'dropped'), 0), 6) AS average_wait_ms, round(coalesce(avg(ended_ms - started_ms) FILTER (WHERE outcome <> 'dropped'), 0), 6) AS average_run_ms, coalesce(max(max_depth), 0) AS max_depth FROM req LEFT JOIN q USING (coordinator) GROUP BY coordinator""",
)
Q["G8_metrics_by_kind"] = (
    lambda spark, sf_dir: R.metrics_by_kind(_requests(spark, sf_dir)).select("coordinator", F.explode("wait_by_kind").alias("kind", "wait"), "run_by_kind", "completed_by_kind").select("coordinator", "kind", F.round("wait", 6).alias("wait"), F.round(F.col("run_by_kind")[F.col("kind")], 6).alias("run"), F.col("completed_by_kind")[F.col("kind")].alias("completed")),
    "WITH " + _REQ + " SELECT coordinator, kind, round(avg(started_ms - submitted_ms), 6) AS wait, round(avg(ended_ms - started_ms), 6) AS run, count(*) FILTER (WHERE outcome = 'completed') AS completed FROM req WHERE outcome <> 'dropped' GROUP BY coordinator, kind",
)
Q["T1_framed_packets"] = (
    lambda spark, sf_dir: R.framed(X.events(spark, sf_dir).selectExpr("user_id AS session_id", "event_id AS seq", "100 + event_id % 333 AS n_samples"), 512),
    """WITH p AS (SELECT user_id AS session_id, event_id AS seq, 100 + event_id % 333 AS n, CAST(sum(100 + event_id % 333) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS total FROM events)
    SELECT session_id, unnest(range((total - n) // 512, total // 512)) AS frame, seq FROM p""",
)
Q["T15_priority_schedule"] = (
    lambda spark, sf_dir: R.pending_order(X.events(spark, sf_dir).selectExpr("user_id % 20 AS coordinator", "event_id AS seq", "CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 4 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 10 ELSE 15 END AS priority")),
    """SELECT *, row_number() OVER (PARTITION BY coordinator ORDER BY priority, seq) AS turn FROM (SELECT user_id % 20 AS coordinator, event_id AS seq, CASE event_type WHEN 'click' THEN 0 WHEN 'view' THEN 4 WHEN 'purchase' THEN 5 WHEN 'signup' THEN 10 ELSE 15 END AS priority FROM events) AS t""",
)
Q["T20_latency_metrics"] = (
    _sent(lambda s: R.latency_metrics(
        s.select(F.col("job_id").alias("session_id"), F.col("ord").alias("utterance"), "start_ms", F.explode(F.sequence(F.lit(0), F.expr("cast(ord % 4 as int)"))).alias("k")).selectExpr("session_id", "utterance", "start_ms", "start_ms + 900 + k * (700 + utterance) AS at_ms"),
        s.selectExpr("job_id AS session_id", "ord AS utterance", "end_ms", "end_ms + 300 + ord % 50 AS at_ms")).select("session_id", *[F.round(c, 6).alias(c) for c in ("first_partial_ms", "partial_interval_ms", "final_ms")])),
    X.with_views(_S) + """ SELECT job_id AS session_id, 900.0e0 AS first_partial_ms, round(sum((ord % 4) * (700.0e0 + ord)) / nullif(sum(ord % 4), 0), 6) AS partial_interval_ms, round(avg(300.0e0 + ord % 50), 6) AS final_ms FROM sentences GROUP BY job_id""",
)


# text functions
Q["F5_name_helpers"] = (
    lambda spark, sf_dir: X.events(spark, sf_dir).select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("up/realtime_"), F.col("event_id").cast("string"), F.lit(".wav"))).otherwise(F.concat(F.lit("a/talk."), F.col("event_id").cast("string"), F.lit(".mp3"))).alias("name"), F.col("ts").cast("timestamp").alias("at"), F.when(F.col("event_id") % 2 == 0, "full_text").otherwise("live").alias("mode")).select("event_id", T.display_name("name", "at").alias("shown"), T.document_label("name", "at").alias("label"), T.export_title("name", "at", "mode").alias("title")),
    """WITH e AS (SELECT event_id, event_id % 3 = 0 AS live, 'realtime_' || CAST(event_id AS VARCHAR) AS rt, 'talk.' || CAST(event_id AS VARCHAR) AS stem, ts + INTERVAL 7 HOUR AS t, event_id % 2 = 0 AS whole FROM events),
    d AS (SELECT *, 'Ghi âm trực tiếp · ' || strftime(t, '%d/%m/%Y %H:%M') AS shown_, 'Ghi âm ' || strftime(t, '%d-%m-%Y %H-%M') AS exp FROM e)
    SELECT event_id, CASE WHEN live THEN shown_ ELSE 'a/' || stem || '.mp3' END AS shown, CASE WHEN live THEN shown_ ELSE stem END AS label, CASE WHEN whole THEN 'Toàn văn - ' || CASE WHEN live THEN exp ELSE stem END WHEN live THEN rt ELSE stem END AS title FROM d""",
)
_DOCMD = "md AS (SELECT job_id, ord, CASE WHEN ord % 2 = 0 THEN '# ' ELSE '' END || regexp_extract(text, '^[^.\n]*') || ' ##' || chr(10) || 'body' AS text FROM sentences)"


def _md(s):
    return s.select("job_id", "ord", F.concat(F.when(F.col("ord") % 2 == 0, F.lit("# ")).otherwise(F.lit("")), F.regexp_extract("text", r"^[^.\n]*", 0), F.lit(" ##\nbody")).alias("md"), F.lit(" ").alias("none"))


Q["F7_document_heading"] = (
    _sent(lambda s: _md(s).select("job_id", "ord", D.document_title("md", "none").alias("title"), D.without_heading("md").alias("rest"))),
    X.with_views(_S, _DOCMD) + r""" SELECT job_id, ord, replace(upper(coalesce(nullif(trim(regexp_replace(regexp_extract(text, '^# ([^\n]*)', 1), '[ \t]+#+[ \t]*$', '')), ''), 'document')), 'ẞ', 'SS') AS title,
      CASE WHEN ord % 2 = 0 THEN 'body' ELSE text END AS rest FROM md""",
)
Q["F8_sections"] = (
    _sent(lambda s: D.sections(P.ordered_join(s, F.concat(F.when(F.col("ord") % 3 == 2, F.concat(F.lit("## Part "), F.col("ord").cast("string"), F.lit("\n"))).otherwise(""), F.regexp_replace("text", r"\s+", " ")), "\n", "text").withColumnRenamed("job_id", "doc_id"))),
    X.with_views(_S) + r""", p AS (SELECT job_id, sum(CASE WHEN ord % 3 = 2 THEN 1 ELSE 0 END) OVER (PARTITION BY job_id ORDER BY ord) AS place, ord, regexp_replace(text, '\s+', ' ', 'g') AS text FROM sentences)
    SELECT job_id AS doc_id, CAST(place AS BIGINT) AS place, CASE WHEN place > 0 THEN 'Part ' || CAST(min(ord) AS VARCHAR) END AS heading, trim(string_agg(text, chr(10) ORDER BY ord)) AS body FROM p GROUP BY job_id, place""",
)
_WORDS = lambda s: F.transform(F.filter(F.split("text", r"\s+"), lambda w: w != ""), lambda w, k: F.struct(w.alias("text"), (s + k * 100).alias("s"), (s + k * 100 + 80).alias("e")))  # noqa: E731, E501
_SQLW = r"w AS (SELECT job_id, ord, start_ms, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws, text FROM sentences)"
Q["F10_word_to_char_times"] = (
    _sent(lambda s: s.select("job_id", "ord", T.chars_of_words(F.transform(_WORDS(F.col("start_ms")), lambda w: F.struct(F.concat(F.lit(" "), w["text"]).alias("text"), w["s"], w["e"]))).alias("c")).select("job_id", "ord", F.array_join(F.transform("c", lambda x: x["c"]), "").alias("said"), F.get("c", 0)["s"].alias("s"), F.element_at("c", -1)["e"].alias("e"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["s"]).alias("total"))),
    X.with_views(_S, _SQLW) + """ SELECT job_id, ord, array_to_string(ws, ' ') AS said, start_ms AS s, start_ms + len(ws) * 100 - 20 AS e, CAST(list_sum(list_transform(range(len(ws)), lambda k: (start_ms + k * 100) * (length(ws[CAST(k + 1 AS INT)]) + CASE WHEN k = 0 THEN 0 ELSE 1 END))) AS BIGINT) AS total FROM w WHERE len(ws) > 0""",
)
Q["F10_token_to_char_times"] = (
    _sent(lambda s: s.select("job_id", "ord", F.transform(_WORDS(F.col("start_ms")), lambda w: F.struct(F.concat(F.lit("▁"), w["text"]).alias("text"), w["s"])).alias("t")).select("job_id", "ord", T.chars_of_tokens("t").alias("c")).select("job_id", "ord", F.size("c").cast("long").alias("n"), F.element_at("c", -1)["e"].alias("e"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["e"]).alias("total"))),
    X.with_views(_S, _SQLW) + """ SELECT job_id, ord, CAST(length(array_to_string(ws, ' ')) AS BIGINT) AS n, start_ms + len(ws) * 100 - 20 AS e, CAST(list_sum(list_transform(range(len(ws)), lambda k: (start_ms + k * 100 + CASE WHEN k = len(ws) - 1 THEN 80 ELSE 100 END) * (length(ws[CAST(k + 1 AS INT)]) + CASE WHEN k = 0 THEN 0 ELSE 1 END))) AS BIGINT) AS total FROM w WHERE len(ws) > 0""",
)
Q["F10_aligned_char_times"] = (
    _sent(lambda s: s.withColumn("text", F.array_join(F.filter(F.split("text", r"\s+"), lambda w: w != ""), " ")).select("job_id", "ord", T.chars_of_aligned("text", _WORDS(F.col("start_ms"))).alias("c")).select("job_id", "ord", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x["s"] + x["e"]).alias("total"))),
    X.with_views(_S, _SQLW) + """ SELECT job_id, ord, CAST(length(array_to_string(ws, ' ')) AS BIGINT) AS n, CAST(list_sum(list_transform(range(len(ws)), lambda k: (2 * (start_ms + k * 100) + 80) * length(ws[CAST(k + 1 AS INT)]) + CASE WHEN k = 0 THEN 0 ELSE 2 * (start_ms + k * 100) - 20 END)) AS BIGINT) AS total FROM w WHERE len(ws) > 0""",
)
_LETTERS = ["<unk>", *"etaoinshrdlu "]
Q["F13_char_tokens"] = (
    _sent(lambda s: s.select("job_id", "ord", T.encode_chars("text", _LETTERS).alias("ids")).select("job_id", "ord", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), T.decode_chars(F.transform("ids", lambda i: F.when(i == 0, 99).otherwise(i)), _LETTERS).alias("text"))),
    X.with_views(_S) + r""" SELECT job_id, ord, array_to_string(list_transform(range(length(text)), lambda k: strpos('etaoinshrdlu ', substr(text, CAST(k + 1 AS INT), 1))), ',') AS ids, regexp_replace(text, '[^etaoinshrdlu ]', '', 'g') AS text FROM sentences""",
)
Q["F17_retry_rules"] = (
    lambda spark, sf_dir: X.events(spark, sf_dir).selectExpr("event_id", "cast(case when event_id % 9 = 0 then null else 400 + event_id % 120 end as int) AS status", "cast(event_id % 5 as int) AS attempt", "case when event_id % 4 = 0 then cast(event_id % 30 as string) when event_id % 4 = 1 then 'soon' end AS after", "format_string('%dm%d.5s', event_id % 7, event_id % 60) AS reset", "props").select("event_id", T.retryable("status").alias("again"), F.round(T.retry_wait("attempt", "after"), 6).alias("wait_s"), T.requested_tokens("props", F.lit(100)).alias("tokens"), F.round(T.duration_seconds("reset"), 6).alias("reset_s")),
    """SELECT event_id, event_id % 9 = 0 OR 400 + event_id % 120 IN (408, 409, 429) OR 400 + event_id % 120 >= 500 AS again, round(greatest(pow(2.0e0, event_id % 5), CASE WHEN event_id % 4 = 0 THEN event_id % 30 + 0.5e0 ELSE 0 END), 6) AS wait_s,
      CAST(greatest(1, (length(props) + 1) // 2) + 100 AS BIGINT) AS tokens, round((event_id % 7) * 60.0e0 + event_id % 60 + 0.5e0, 6) AS reset_s FROM events""",
)


# documents
_C4 = tq.Q["C3_pack_sentences"][1].replace("SELECT f.job_id, f.chunk - 1 AS chunk, a.start_ms, b.end_ms, f.i - greatest(0, f.made - 3) AS n_sentences FROM f", "SELECT f.job_id, f.chunk - 1 AS chunk, a.start_ms, b.end_ms, a.i AS low, f.i AS high FROM f")
Q["C4_chunks_markdown"] = (
    _sent(lambda s: D.chunks_markdown(D.chunk_lines(P.pack_sentences(_lines(s), 150), _lines(s)))),
    "WITH k AS (" + _C4 + "), " + _S + """, s AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ord) - 1 AS i FROM sentences),
    m AS (SELECT k.job_id, chunk, k.start_ms, k.end_ms, coalesce(string_agg(CASE WHEN trim(text) <> '' THEN """ + tq._SQL_MD.replace("start_ms", "s.start_ms") + """ END, chr(10) ORDER BY s.i), '') AS md
      FROM k JOIN s ON s.job_id = k.job_id AND s.i >= low AND s.i < high GROUP BY k.job_id, chunk, k.start_ms, k.end_ms)
    SELECT job_id, string_agg(printf('## CHUNK %d [%.2f → %.2f]', chunk, start_ms / 1000.0e0, end_ms / 1000.0e0) || chr(10) || md || chr(10) || '---', chr(10) ORDER BY chunk) AS markdown FROM m GROUP BY job_id""",
)


def _lines(s):
    return s.withColumn("name", F.concat(F.lit("S"), F.col("speaker").cast("string"))).withColumn("line", F.when(T.strip("text") != "", T.stamped_line("start_ms", "name", "text")))


Q["C5_chunk_on_lines"] = (lambda spark, sf_dir: P.pack_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), 500), None)
_MMSS = "printf('%02d:%02d', {0} // 60000, {0} // 1000 % 60)"
Q["C15_seconds_lines"] = (
    _sent(lambda s: D.transcript_text(s.withColumn("speaker", F.when(F.col("ord") % 3 != 0, F.col("speaker"))), "seconds")),
    X.with_views(_S) + " SELECT job_id, string_agg(printf('[%.1fs] ', start_ms / 1000.0e0) || CASE WHEN ord % 3 <> 0 THEN 'Speaker ' || CAST(speaker AS VARCHAR) || ': ' ELSE '' END || text, chr(10) ORDER BY ord) AS text FROM sentences GROUP BY job_id",
)
Q["C15_range_lines"] = (
    _sent(lambda s: D.transcript_text(s, "range")),
    X.with_views(_S) + f" SELECT job_id, string_agg('[' || {_MMSS.format('start_ms')} || '–' || {_MMSS.format('end_ms')} || '] Speaker ' || CAST(speaker AS VARCHAR) || ': ' || text, chr(10) ORDER BY ord) AS text FROM sentences GROUP BY job_id",
)
_ANSWER = """concat(CASE WHEN event_id % 2 = 0 THEN 'Here: ```json\n' ELSE 'Sure. ' END, CASE WHEN event_id % 7 = 0 THEN '{"content_kind": " ", ' ELSE concat('{"content_kind": "Talk  ', event_id, '", ') END,
  '"outline": [{"id": "a", "heading": "Tổng quan", "kind": "summary"}, {"id": "a", "heading": "Kết luận", "kind": "topic"}', CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(', {"heading": "Topic ', event_id % 5, '", "kind": "x"}') END, ']}', CASE WHEN event_id % 2 = 0 THEN '\n``` done' ELSE ' ok' END)"""
Q["C11_parsed_plans"] = (
    lambda spark, sf_dir: D.parsed_plan(X.events(spark, sf_dir).selectExpr("event_id", f"{_ANSWER} AS answer")).select("event_id", "content_kind", "plan_ok", F.array_join(F.transform("outline", lambda s: F.concat(s["id"], F.lit("|"), s["heading"], F.lit("|"), s["kind"])), ";").alias("outline")),
    """SELECT event_id, CASE WHEN ok THEN 'Talk ' || CAST(event_id AS VARCHAR) ELSE 'Tài liệu' END AS content_kind, ok AS plan_ok, 's1|Tổng quan|summary;s2|' || CASE WHEN ok THEN 'Topic ' || CAST(event_id % 5 AS VARCHAR) ELSE 'Nội dung chính' END || '|topic' AS outline
    FROM (SELECT event_id, event_id % 7 <> 0 AND event_id % 3 <> 0 AS ok FROM events) AS t""",
)
Q["C14_parse_llm_rows"] = (
    lambda spark, sf_dir: D.llm_rows(X.events(spark, sf_dir).selectExpr("event_id", """CASE WHEN event_id % 6 = 5 THEN 'no rows' ELSE concat(CASE WHEN event_id % 2 = 0 THEN 'x ```\n' ELSE 'rows: ' END, '[{"task":"t', event_id, '","timestamp":', event_id % 9, '},{"task":""},{"timestamp":3},{"task":"u","priority":"high"}]', CASE WHEN event_id % 2 = 0 THEN '\n```' ELSE '' END) END AS answer"""), "task string, priority string, timestamp double", "task", {"priority": "medium"}),
    """SELECT event_id, 't' || CAST(event_id AS VARCHAR) AS task, 'medium' AS priority, CAST(event_id % 9 AS DOUBLE) AS timestamp FROM events WHERE event_id % 6 <> 5 UNION ALL SELECT event_id, 'u', 'high', NULL FROM events WHERE event_id % 6 <> 5""",
)


def _c14(spark, sf_dir):
    """A stand-in that fails for some meetings: without a list once (every third), always (every seventh)."""
    asked = []

    def ask(rows):
        asked.append(len(asked))
        n, job = F.length("text").cast("string"), F.col("job_id")
        some = F.when((job % 7 == 0) | ((job % 3 == 0) & F.lit(len(asked) == 1)), "no list").otherwise(
            F.when(F.col("kind") == "topics", F.concat(F.lit('```json\n[{"title":"T'), n, F.lit('","start_time":"1.5"},{"title":""}]\n```')))
            .when(F.col("kind") == "action_items", F.concat(F.lit('Here: [{"task":"A'), n, F.lit('"},{"task":"B","priority":"low","timestamp":"soon"}] done')))
            .otherwise("[]")
        )
        return rows.withColumn("answer", F.when(F.col("kind") != "summary", some).when(job % 5 != 0, F.concat(F.lit(" said "), n, F.lit("\n"))))

    made = D.meeting_summaries(Q["C15_seconds_lines"][0](spark, sf_dir), ask)
    topics = F.transform("topics", lambda t: F.concat_ws("|", t["title"], t["description"], t["start_time"].cast("string"), t["end_time"].cast("string")))
    actions = F.transform("action_items", lambda t: F.concat_ws("|", t["task"], t["priority"], F.coalesce(t["timestamp"].cast("string"), F.lit("none"))))
    return made.select("job_id", "summary", F.array_join(topics, ";").alias("topics"), F.array_join(actions, ";").alias("actions"), F.size("decisions").cast("long").alias("n_decisions"), "calls")


Q["C14_meeting_reports"] = (
    _c14,
    f"""SELECT job_id, CASE WHEN job_id % 5 = 0 THEN '[Không thể tạo tóm tắt]' ELSE 'said ' || length(text) END AS summary,
      CASE WHEN job_id % 7 = 0 THEN '' ELSE 'T' || length(text) || '||1.5|0.0' END AS topics,
      CASE WHEN job_id % 7 = 0 THEN '' ELSE 'A' || length(text) || '|medium|none;B|low|none' END AS actions, CAST(0 AS BIGINT) AS n_decisions,
      CAST(CASE WHEN job_id % 7 = 0 OR job_id % 3 = 0 THEN 7 ELSE 4 END AS BIGINT) AS calls FROM ({Q["C15_seconds_lines"][1]}) AS t""",
)
Q["I22_preassigned_turns"] = (
    _sent(lambda s: Z.finalize_preassigned(s.select("job_id", "ord", "speaker", F.when(F.col("job_id") % 2 == 0, F.regexp_replace("text", "[.!?。！？]", "")).otherwise(F.col("text")).alias("text")), lambda d: d.withColumn("text", F.concat("text", F.lit("."))), native=True)),
    X.with_views(_S) + """, t AS (SELECT job_id, ord, speaker, CASE WHEN job_id % 2 = 0 THEN regexp_replace(text, '[.!?。！？]', '', 'g') ELSE text END AS text FROM sentences),
    j AS (SELECT job_id, string_agg(trim(text), ' ') AS a FROM t WHERE trim(text) <> '' GROUP BY job_id),
    n AS (SELECT job_id, length(a) AS c, length(regexp_replace(a, '[^.!?。！？]', '', 'g')) AS m FROM j)
    SELECT job_id, ord, speaker, CASE WHEN c >= 80 AND (m = 0 OR c / m > 240) THEN text || '.' ELSE text END AS text FROM t LEFT JOIN n USING (job_id)""",
)


def _stand_ins():
    """Plain stand-ins for the model: a fixed plan, drafts that name their chunk, and a merge that counts characters."""
    plan = lambda d: d.withColumn("answer", F.lit('{"content_kind":"Notes","outline":[{"heading":"All","kind":"summary"},{"heading":"Words","kind":"topic"}]}'))
    write = lambda d: d.withColumn("answer", F.concat(F.lit('{"s1":"part '), F.col("chunk").cast("string"), F.lit('","s2":"'), F.when(F.col("chunk") % 2 == 0, F.concat(F.length("text").cast("string"), F.lit(" characters"))).otherwise(F.lit(" ")), F.lit('"}')))
    reduce = lambda d: d.withColumn("answer", F.concat(F.lit("merged "), F.length("text").cast("string")))
    return plan, write, reduce


Q["C9_write_documents"] = (lambda spark, sf_dir: D.write_documents(_table(spark, sf_dir, "documents").select("doc_id", "text"), *_stand_ins(), chunk_chars=2000), None)


# audio, clusters
def _wave(spark, sf_dir):
    return X.embedded(spark, sf_dir).select(F.col("vec_id").alias("id"), F.flatten(F.array_repeat("embedding", 8)).alias("samples"))


Q["W8_log_mel"] = (lambda spark, sf_dir: A.log_mel(_wave(spark, sf_dir)).select("id", "t", F.posexplode("v").alias("mel", "x")).select("id", "t", F.col("mel").cast("long").alias("mel"), F.round("x", 6).alias("x")), None)
Q["F11_align_punctuated"] = (
    _sent(lambda s: Z.align_punctuated(s.select((F.col("job_id") * 1000 + F.col("ord")).alias("id"), F.lower(F.regexp_replace("text", "[.,]", "")).alias("old"), F.col("text").alias("new")).withColumn("ts", F.transform(F.sequence(F.lit(1), F.length("old")), lambda k: (k * 10).cast("long")))).select("id", F.posexplode("ts").alias("place", "ms")).select("id", F.col("place").cast("long").alias("place"), "ms")),
    None,
)


def _quiet(spark, sf_dir):
    turns = X.sentences(spark, sf_dir).select("job_id", "ord", F.expr("start_ms div 10 * 10").alias("start_ms"), F.expr("end_ms div 10 * 10").alias("end_ms"))
    wave = lambda k: F.sin(k * 0.7) * (F.expr("1.0D") + F.sin(k * 0.013)) * 0.1
    audio = turns.groupBy("job_id").agg(F.max("end_ms").alias("n")).select("job_id", F.transform(F.sequence(F.lit(0).cast("long"), F.col("n")), wave).alias("samples"))
    return A.split_at_quiet(turns, audio, rate=1000, most=1500, search=400, least=200)


Q["I6_split_long_turns"] = (_quiet, None)
Q["E8_cluster_speakers"] = (lambda spark, sf_dir: V.cluster_speakers(X.embedded(spark, sf_dir)), None)


# live sessions
_PACKETS = "SELECT user_id % 20 AS session_id, event_id AS seq, CASE WHEN event_type IN ('click', 'view', 'purchase') THEN 'put' ELSE 'get' END AS kind FROM events"
Q["T2_bounded_queue"] = (
    lambda spark, sf_dir: L.accepted_packets(spark.sql(_PACKETS.replace("FROM events", "FROM {events}"), events=X.events(spark, sf_dir)), 20),
    "WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM (" + _PACKETS + """) AS t),
    f AS (SELECT session_id, seq, rn, CASE WHEN kind = 'put' THEN 1 ELSE 0 END AS depth, kind = 'put' AS taken FROM p WHERE rn = 1
      UNION ALL SELECT p.session_id, p.seq, p.rn, CASE WHEN p.kind = 'put' THEN least(20, f.depth + 1) ELSE greatest(0, f.depth - 1) END, p.kind = 'put' AND f.depth < 20 FROM f JOIN p ON p.session_id = f.session_id AND p.rn = f.rn + 1)
    SELECT session_id, seq FROM f WHERE taken""",
)
Q["T7_recognition_windows"] = (
    lambda spark, sf_dir: L.recognition_windows(X.vad(spark, sf_dir).withColumn("reason", F.lit("speech_end"))),
    X.with_views(_S, _V) + " SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY start_ms, end_ms) - 1 AS window, start_ms, end_ms, end_ms - start_ms AS duration_ms, 'speech_end' AS reason FROM vad WHERE end_ms > start_ms",
)
Q["T8_confirmed_end"] = (
    _sent(lambda s: L.confirmations(s.select(F.col("job_id").alias("session_id"), F.col("ord").alias("seq"), "end_ms", (F.col("ord") % 4 != 1).alias("ok")))),
    X.with_views(_S) + """ SELECT job_id AS session_id, ord AS seq, CAST(count(*) FILTER (WHERE ord % 4 <> 1) OVER w AS BIGINT) AS confirmed, CAST(count(*) FILTER (WHERE ord % 4 = 1) OVER w AS BIGINT) AS failed,
      max(CASE WHEN ord % 4 <> 1 THEN end_ms END) OVER w AS confirmed_end_ms FROM sentences WINDOW w AS (PARTITION BY job_id ORDER BY ord ROWS UNBOUNDED PRECEDING)""",
)
Q["T9_evict_confirmed"] = (
    lambda spark, sf_dir: L.evicted(X.vad(spark, sf_dir).select(F.col("job_id").alias("session_id"), "start_ms", "end_ms"), X.sentences(spark, sf_dir).filter("job_id % 4 <> 0 and ord < 3").groupBy(F.col("job_id").alias("session_id")).agg(F.max("end_ms").alias("confirmed_end_ms"))),
    X.with_views(_S, _V) + """, c AS (SELECT job_id, max(end_ms) AS c FROM sentences WHERE job_id % 4 <> 0 AND ord < 3 GROUP BY job_id)
    SELECT v.job_id AS session_id, greatest(start_ms, coalesce(c, start_ms)) AS start_ms, end_ms FROM vad v LEFT JOIN c ON v.job_id = c.job_id WHERE c IS NULL OR end_ms > c""",
)
Q["T11_stale_generations"] = (
    lambda spark, sf_dir: L.current_work(X.events(spark, sf_dir).selectExpr("user_id % 50 AS key", "event_id AS seq", "event_id div 400 + event_id % 3 AS generation")),
    """SELECT key, seq, generation FROM (SELECT *, max(generation) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (SELECT user_id % 50 AS key, event_id AS seq, event_id // 400 + event_id % 3 AS generation FROM events) AS t) AS u WHERE b IS NULL OR generation >= b""",
)
_JOBLOG = "SELECT user_id % 60 AS job, event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'done' ELSE 'upsert' END AS kind, event_id % 9 AS id FROM events"
Q["T21_snapshot_and_tail"] = (
    lambda spark, sf_dir: L.replayed(spark.sql(_JOBLOG.replace("FROM events", "FROM {events}"), events=X.events(spark, sf_dir)), spark.range(60).select(F.col("id").alias("job"), F.explode(F.array(F.lit(1), F.lit(2))).alias("subscriber")).selectExpr("job", "subscriber", "cast(subscriber * 300 + job as bigint) AS since")),
    "WITH l AS (" + _JOBLOG + """), s AS (SELECT unnest(range(60)) AS job), b AS (SELECT job, n AS subscriber, CAST(n * 300 + job AS BIGINT) AS since FROM s CROSS JOIN (SELECT unnest([1, 2]) AS n) AS q),
    e AS (SELECT job, min(seq) AS last FROM l WHERE kind = 'done' GROUP BY job), j AS (SELECT l.job, subscriber, seq, kind, id, since FROM l JOIN b ON l.job = b.job LEFT JOIN e ON l.job = e.job WHERE last IS NULL OR seq <= last)
    SELECT job, subscriber, seq, kind, id, CASE WHEN seq <= since THEN 'snapshot' ELSE 'tail' END AS part FROM (SELECT *, max(seq) OVER (PARTITION BY job, subscriber, id, seq <= since) AS n FROM j) AS t WHERE seq > since OR seq = n""",
)
Q["E9_diarize"] = (
    lambda spark, sf_dir: N.diarize(X.vad(spark, sf_dir), lambda c: c.withColumn("embedding", F.array(*[F.sin(F.expr("start_ms div 4000 % 3") * 2.0 + k) + F.sin(F.col("start_ms") * 0.37 + k) * 0.05 for k in range(6)]))),
    None,
)
Q["K11_report_json"] = (lambda spark, sf_dir: _report(spark, sf_dir).select("meeting_id", F.to_json(F.struct("*")).alias("json")),
    X.with_views(_S) + """ SELECT job_id AS meeting_id, CAST(to_json({'meeting_id': job_id, 'duration_ms': max(end_ms), 'sentences': list({'speaker': speaker, 'text': text} ORDER BY ord),
      'actions': coalesce(list({'task': 'task ' || CAST(ord AS VARCHAR)} ORDER BY 'task ' || CAST(ord AS VARCHAR)) FILTER (ord % 3 = 0), [])}) AS VARCHAR) AS json FROM sentences GROUP BY job_id""")
