"""Documents and records: chunks against a plain version, plans, map and reduce with stand-in models, stored reports."""

import random
import re

from pyspark.sql import functions as F

from turnlens.operators import documents as D
from turnlens.operators import records as R
from turnlens.operators import transcripts as P


def plain_chunks(text, limit):
    """C5 and C6, one text at a time, by cutting and joining whole strings."""
    pieces = []
    for line in text.split("\n"):
        if len(line) <= limit:
            pieces.append(line)
            continue
        parts = re.split(r"(?<=[.!?;])\s+", line)
        parts = parts if len(parts) > 1 else re.split(r"(?<=,)\s+", line)
        hard = [p[i : i + limit] for p in parts for i in range(0, len(p), limit)]
        if len(parts) == 1:
            pieces += hard
            continue
        now = ""
        for p in hard:
            if now and len(now) + len(p) + 1 > limit:
                pieces.append(now)
                now = p
            else:
                now = f"{now} {p}".strip() if now else p
        pieces += [now] if now else []
    out, now = [], None
    for p in pieces:
        if now is not None and len(now) + 1 + len(p) > limit:
            out.append(now)
            now = p
        else:
            now = p if now is None else f"{now}\n{p}"
    return out + ([now] if now is not None else []) or [text]


def test_chunks(spark):
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcé") for _ in range(draw.randrange(1, 14)))
    texts = ["", "aa\nbb\ncccccccc", "x" * 35, "one. two! " * 9, "a, b" * 12, "\n\n\n", "p. " + "q" * 25]
    texts += ["".join(word() + draw.choice([" ", " ", ". ", ", ", "\n", "\n\n", "; "]) for _ in range(draw.randrange(1, 60))) for _ in range(60)]
    rows = spark.createDataFrame([*enumerate(texts), (999, None)], "doc_id long, text string")
    for limit in (5, 12, 40):
        got = {}
        for r in P.pack_lines(rows, limit).orderBy("doc_id", "chunk").collect():
            got.setdefault(r["doc_id"], []).append(r["text"])
        assert got == {k: plain_chunks(t, limit) for k, t in enumerate(texts)}
        assert all(len(c) <= limit for x in got.values() for c in x)


def test_outline(spark):
    kind = "array<struct<id:string,heading:string,kind:string>>"
    rows = [(1, [("a", " H ", "topic"), ("a", None, ""), (None, "x" * 300, "k"), ("s3", "y", "z")]), (2, None), (3, [(str(k), f"h{k}", "topic") for k in range(12)])]
    df = spark.createDataFrame(rows, f"k long, o {kind}").select("k", D.outline(F.col("o")).alias("o"), D.report_outline(F.col("o")).alias("r"))
    got = {r["k"]: r for r in df.collect()}
    assert [tuple(s) for s in got[1]["o"]] == [("a", "H", "topic"), ("s2_2", "Tóm tắt", "summary"), ("s3", "x" * 200, "k"), ("s4_4", "y", "z")]
    assert got[2]["o"] == [] and [s["heading"] for s in got[2]["r"]] == ["Tổng quan", "Nội dung chính"]
    assert len(got[3]["o"]) == 7 and [s["id"] for s in got[3]["r"]] == [f"s{k}" for k in range(1, 8)] and [s["kind"] for s in got[3]["r"]][:2] == ["summary", "topic"]


def test_map_reduce(spark):
    """One plan a text, one map a chunk, one reduce for each section of several drafts; every question within its limit."""
    asked = {"plan": [], "write": [], "reduce": []}

    def keep(name, answer, size):
        def ask(df):
            asked[name].append(df.select(F.length(size).alias("n"), *[c for c in df.columns if c == "doc_id"]))
            return df.withColumn("answer", answer)

        return ask

    plan = keep("plan", F.lit('```json\n{"content_kind":" My  notes ","outline":[{"heading":"All","kind":"summary"},{"heading":"Words","kind":"topic"}]}```'), "sample")
    write = keep("write", F.concat(F.lit('{"s1":"draft '), F.col("chunk").cast("string"), F.lit('","s2":"'), F.when(F.col("chunk") == 0, "only").otherwise(" "), F.lit('","s9":"nowhere"}')), "text")
    reduce = keep("reduce", F.upper("text"), "text")
    texts = spark.createDataFrame([(1, "\n".join(["word " * 10] * 30)), (2, "short"), (3, "  "), (4, None)], "doc_id long, text string")
    rows = {(r["doc_id"], r["id"]): r for r in D.write_documents(texts, plan, write, reduce, plan_chars=300, chunk_chars=400, reduce_chars=60).collect()}
    assert set(rows) == {(1, "s1"), (1, "s2"), (2, "s1"), (2, "s2")} and rows[1, "s1"]["content_kind"] == "My notes"
    assert rows[2, "s1"]["markdown"] == "draft 0" and rows[1, "s2"]["markdown"] == "only" and rows[1, "s1"]["markdown"].startswith("DRAFT 0")
    chunks = P.pack_lines(texts.filter("doc_id < 3"), 400).count()
    sizes = {k: [r["n"] for df in x for r in df.collect()] for k, x in asked.items()}
    assert len(sizes["plan"]) == 2 and len(sizes["write"]) == chunks and len(sizes["reduce"]) == 1
    assert max(sizes["plan"]) <= 300 and max(sizes["write"]) <= 400 and max(sizes["reduce"]) <= 60


def test_asked_again(spark):
    df = spark.createDataFrame([(1, '{"a":1}'), (2, "nothing"), (3, None)], "k long, answer string")
    ok = D.json_object("answer").rlike(r"^\{")
    again = D.asked_again(df, ok, lambda d: d.withColumn("answer", F.concat(F.lit('{"k":'), F.col("k").cast("string"), F.lit("}"))))
    assert sorted((r["k"], r["answer"], r["calls"]) for r in again.collect()) == [(1, '{"a":1}', 1), (2, '{"k":2}', 2), (3, '{"k":3}', 2)]


def test_headings(spark):
    texts = ["# Title ##\nbody", "  \n# T\nx", "no heading", "## sub\nx", "#\nx", ""]
    rows = spark.createDataFrame([(k, t, " name ") for k, t in enumerate(texts)], "k long, t string, f string").select("k", D.leading_heading("t").alias("h"), D.document_title("t", "f").alias("title"), D.without_heading("t").alias("rest"))
    got = {r["k"]: r for r in rows.collect()}
    assert [got[k]["h"] for k in range(6)] == ["Title", "T", None, None, None, None]
    assert got[0]["title"] == "TITLE" and got[2]["title"] == "NAME" and got[0]["rest"] == "body" and got[3]["rest"] == "## sub\nx"


def test_reports_of_ended_runs(spark, tmp_path):
    rows = [(1, 10, [("a",), ("b",)]), (2, 20, [])]
    tables = R.report_tables(spark.createDataFrame(rows, "meeting_id long, duration_ms long, topics array<struct<title:string>>"), ["topics"])
    R.write_report(tables, str(tmp_path), "one")
    R.write_report(tables, str(tmp_path), "one")  # again: the same rows
    tables["topics"].write.parquet(str(tmp_path / "topics" / "run=broken"))  # a run that did not end
    assert sorted((r["meeting_id"], r["place"], r["title"]) for r in R.read_report(spark, str(tmp_path), "topics").collect()) == [(1, 0, "a"), (1, 1, "b")]
    assert R.read_report(spark, str(tmp_path), "meetings").count() == 2


def test_update_needs_every_record(spark):
    records = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (3, 1, "d")], "job_id long, id long, v string")
    updates = spark.createDataFrame([(1, 1, "A"), (1, 2, "B"), (2, 1, "C"), (2, 9, "X")], "job_id long, id long, v string")
    got = sorted((r["job_id"], r["id"], r["v"], r["applied"]) for r in R.update_by_id(records, updates, "id", "v").collect())
    assert got == [(1, 1, "A", True), (1, 2, "B", True), (2, 1, "c", False), (3, 1, "d", False)]


def test_replacements_are_all_or_nothing(spark):
    records = spark.createDataFrame([(1, 0, 0, 1000, 0, "a"), (1, 1, 1000, 2000, 0, "b"), (2, 0, 0, 500, 0, "c")], "job_id long, ord long, start_ms long, end_ms long, speaker int, text string")
    kind = "job_id long, ord long, place int, start_s double, end_s double, speaker int, text string, replaced boolean"
    good = [(1, 0, 0, 0.0, 1.0, 7, "a", False), (1, 1, 0, 0.9, 1.4995, 1, " x ", True), (1, 1, 1, 1.4995, 2.6, 2, "y", True)]
    rows = lambda extra: sorted((r["job_id"], r["start_ms"], r["end_ms"], r["speaker"], r["text"], r["applied"]) for r in R.replace_segments(records, spark.createDataFrame([*good, *extra], kind)).collect())
    ok = [(1, 0, 1000, 7, "a", True), (1, 1000, 1500, 1, "x", True), (1, 1500, 2000, 2, "y", True)]
    assert rows([(2, 0, 0, 0.0, 0.5, 3, "c", False)]) == [*ok, (2, 0, 500, 3, "c", True)]
    for broken in ([], [(2, 0, 0, 0.0, 0.5, 3, " ", True)], [(2, 0, 0, 0.6, 0.9, 3, "z", True)], [(2, 0, 0, 0.0, 0.5, 3, "c", False), (2, 5, 0, 0.0, 0.1, 0, "q", False)], [(2, 0, k, 0.0, 0.5, 3, "c", False) for k in (0, 1)]):
        assert rows(broken) == [*ok, (2, 0, 500, 0, "c", False)]


def test_diarize(spark):
    """Two voices in turn come out as their stretches, met in the middle of the chunks that overlap."""
    from turnlens.operators.diarize import diarize

    segments = spark.createDataFrame([(1, 0, 0, 12_000), (1, 1, 12_000, 24_000), (2, 0, 0, 1_000)], "job_id long, ord long, start_ms long, end_ms long")
    embed = lambda c: c.withColumn("embedding", F.when(F.col("start_ms") < 12_000, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))))
    rows = sorted((r["job_id"], r["start_ms"], r["end_ms"], r["speaker"]) for r in diarize(segments, embed).collect())
    assert [(j, a, b) for j, a, b, _ in rows] == [(1, 0, 12_000), (1, 12_000, 24_000), (2, 0, 1_000)] and rows[0][3] != rows[1][3]
    assert diarize(segments.filter("false"), embed).count() == 0


def test_meeting_summaries(spark):
    asked = []

    def ask(rows):
        asked.append({(r["job_id"], r["kind"]) for r in rows.collect()})
        known = {("topics", 1): '[{"title": "a", "start_time": 2, "end_time": "x"}, {"description": "b"}, 7]', ("decisions", 1): '```json\n[{"content": "d", "timestamp": "3.5"}]\n```'}
        if len(asked) > 1:
            known["action_items", 1] = 'see [{"task": "t", "priority": null, "assignee": "An"}].'
        return rows.join(spark.createDataFrame([(j, k, t) for (k, j), t in known.items()] + [(1, "summary", " s\n"), (2, "topics", '{"title": "no list"}')], "job_id long, kind string, answer string"), ["job_id", "kind"], "left")

    texts = spark.createDataFrame([(1, "text"), (2, None)], "job_id long, text string")
    got = {r["job_id"]: r.asDict(recursive=True) for r in D.meeting_summaries(texts, ask, "en").collect()}
    action = {"task": "t", "assignee": "An", "deadline": None, "priority": "medium", "mentioned_by": None, "timestamp": None}
    assert got[1] == {"job_id": 1, "summary": "s", "topics": [{"title": "a", "description": "", "start_time": 2.0, "end_time": 0.0}], "action_items": [action], "decisions": [{"content": "d", "made_by": "Team", "timestamp": 3.5}], "calls": 5}
    assert got[2] == {"job_id": 2, "summary": "[Summary unavailable]", "topics": [], "action_items": [], "decisions": [], "calls": 7}
    assert len(asked) == 2 and asked[1] == {(1, "action_items"), (2, "topics"), (2, "action_items"), (2, "decisions")}
    assert D.meeting_summaries(texts.filter("false"), lambda d: d.withColumn("answer", F.lit(None).cast("string"))).count() == 0
