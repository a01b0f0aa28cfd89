"""Documents made from transcripts: plans and outlines, map over chunks, reduce by section, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .finalize import bounded_join
from .scans import cut_lineage, numbered
from .transcripts import ordered_join, pack_lines

#: Fixed values of outlines: sections and label characters at most, topics at most, words of a title at most.
MOST_SECTIONS, LABEL, MOST_TOPICS, TITLE_WORDS = 7, 200, 6, 14
#: Headings that name no topic; the labels that stand in for missing ones.
GENERIC = ("phân tích theo chủ đề", "các điểm chính", "kết luận", "trích dẫn nổi bật")
OVERVIEW, SUMMARY, MAIN_TOPIC, UNTITLED = "Tổng quan", "Tóm tắt", "Nội dung chính", "Tài liệu"
SECTION = "struct<id:string,heading:string,kind:string>"


def transcript_text(sentences: DataFrame, style: str) -> DataFrame:
    """(job_id, text): one line a sentence, in order. ``style``: stamped ([12.34] name: text, blank texts left out),
    seconds ([12.3s] Speaker 1: text) or range ([00:12–00:15] Speaker 1: text). An unknown speaker is left out."""
    who = F.coalesce(F.concat(F.lit("Speaker "), F.col("speaker").cast("string"), F.lit(": ")), F.lit(""))
    if style == "stamped":
        named = sentences.withColumn("name", F.coalesce(F.col("speaker").cast("string"), F.lit("UNKNOWN")))
        line = F.when(T.strip("text") != "", T.stamped_line("start_ms", "name", "text"))
    elif style == "seconds":
        named, line = sentences, F.concat(F.lit("["), T.fixed("start_ms", 1), F.lit("s] "), who, "text")
    else:
        named, line = sentences, F.concat(T.time_range("start_ms", "end_ms"), F.lit(" "), who, "text")
    return ordered_join(named, line, "\n", "text")


def chunks_markdown(chunks: DataFrame) -> DataFrame:
    """C4: (job_id, markdown) of chunks (job_id, chunk, start_ms, end_ms, markdown), in order."""
    head = F.concat(F.lit("## CHUNK "), F.col("chunk").cast("string"), F.lit(" ["), T.fixed("start_ms", 2), F.lit(" → "), T.fixed("end_ms", 2), F.lit("]\n"))
    return ordered_join(chunks, F.concat(head, "markdown", F.lit("\n---")), "\n", "markdown", by="chunk")


def chunk_lines(packed: DataFrame, sentences: DataFrame) -> DataFrame:
    """C4: the chunks of ``pack_sentences`` with their ``markdown``: the lines of the sentences from each chunk's first,
    in order. ``sentences``: job_id, ord, line (null where blank). Sentences may start at one time, and ``ord`` may have
    holes: they are counted by their places."""
    rows = cut_lineage(numbered(sentences.select("job_id", "ord", "line"), ["job_id"], "ord"))
    first = packed.join(rows.select("job_id", F.col("ord").alias("first"), F.col("place").alias("low")), ["job_id", "first"])
    places = first.select("job_id", "chunk", "start_ms", "end_ms", F.explode(F.expr("sequence(low, low + n_sentences - 1)")).alias("place"))
    parts = F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("place", "line"))))
    lines = places.join(rows, ["job_id", "place"]).groupBy("job_id", "chunk", "start_ms", "end_ms")
    return lines.agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("markdown"))


def json_object(c) -> Column:
    """C11: the text of the JSON object in a model's answer: inside a code fence, else from the first { to the last }."""
    fenced = F.regexp_extract(c, r"(?is)```(?:json)?(.*?)```", 1)
    bare = F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit("")), F.col(c))
    return F.nullif(T.strip(F.when(F.col(c).rlike(r"(?is)```.*```"), fenced).otherwise(bare)), F.lit(""))


def json_array(c) -> Column:
    """C14: the text of the JSON array in a model's answer: inside a code fence, else from the first [ to the last ]."""
    fenced = F.regexp_extract(c, r"(?is)```(?:json)?(.*?)```", 1)
    bare = F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)\[.*\]", 0), F.lit("")), F.col(c))
    return F.nullif(T.strip(F.when(F.col(c).rlike(r"(?is)```.*```"), fenced).otherwise(bare)), F.lit(""))


def safe_text(c, default: str) -> Column:
    """C11: trimmed text, or the default where it is null or blank."""
    return F.coalesce(F.nullif(T.strip(c), F.lit("")), F.lit(default))


def title(c, default: str = UNTITLED) -> Column:
    """C11: one line of at most 14 words."""
    return F.array_join(F.slice(F.split(safe_text(c, default), r"\s+"), 1, TITLE_WORDS), " ")


def outline(c) -> Column:
    """C11: an outline (array of id, heading, kind) of at most seven sections with labels and ids of their own; an id
    that is taken already becomes s<place>_<ids so far + 1>."""
    none = F.array().cast(f"array<{SECTION}>")

    def step(done, s):
        wanted = F.left(F.coalesce(F.nullif(T.strip(s["s"]["id"]), F.lit("")), F.concat(F.lit("s"), s["k"].cast("string"))), F.lit(LABEL))
        taken = F.exists(done, lambda d: d["id"] == wanted)
        fresh = F.concat(F.lit("s"), s["k"].cast("string"), F.lit("_"), (F.size(done) + 1).cast("string"))
        label = lambda x, default: F.left(safe_text(x, default), F.lit(LABEL))
        made = F.struct(F.when(taken, fresh).otherwise(wanted).alias("id"), label(s["s"]["heading"], SUMMARY).alias("heading"), label(s["s"]["kind"], "summary").alias("kind"))
        return F.array_append(done, made)

    numbered = F.transform(F.slice(F.coalesce(c, none), 1, MOST_SECTIONS), lambda s, k: F.struct(s.alias("s"), (k + 1).alias("k")))
    return F.aggregate(F.filter(numbered, lambda x: x["s"].isNotNull()), none, step)


def report_outline(c) -> Column:
    """C11: an overview, then up to six topics of the outline (those that name one), with ids s1, s2, ..."""
    topics = F.transform(F.slice(F.filter(outline(c), lambda s: (s["kind"] != "summary") & ~F.lower(s["heading"]).isin(*GENERIC)), 1, MOST_TOPICS), lambda s: s["heading"])
    named = F.when(F.size(topics) == 0, F.array(F.lit(MAIN_TOPIC))).otherwise(topics)
    all_ = F.concat(F.array(F.lit(OVERVIEW)), named)
    kind = lambda k: F.when(k == 0, "summary").otherwise("topic")
    return F.transform(all_, lambda h, k: F.struct(F.concat(F.lit("s"), (k + 1).cast("string")).alias("id"), h.alias("heading"), kind(k).alias("kind")))


def parsed_plan(answers: DataFrame, column: str = "answer") -> DataFrame:
    """C11: ``answers`` with content_kind, outline and plan_ok. A plan needs a title, a summary and a topic; where it
    has not, the fallback (untitled, overview and main topic) stands."""
    parsed = F.from_json(json_object(column), f"struct<content_kind:string,outline:array<{SECTION}>>")
    rows = answers.withColumn("_plan", parsed).withColumn("_sections", outline(F.col("_plan.outline")))
    summary = F.exists("_sections", lambda s: s["kind"] == "summary")
    topic = F.exists("_sections", lambda s: (s["kind"] != "summary") & ~F.lower(s["heading"]).isin(*GENERIC))
    ok = F.coalesce((T.strip(F.col("_plan.content_kind")) != "") & summary & topic, F.lit(False))
    none = F.lit(None).cast(f"array<{SECTION}>")
    return rows.select(*answers.columns, F.when(ok, title(F.col("_plan.content_kind"))).otherwise(UNTITLED).alias("content_kind"), report_outline(F.when(ok, F.col("_plan.outline")).otherwise(none)).alias("outline"), ok.alias("plan_ok"))


def asked_again(answers: DataFrame, valid: Column, ask) -> DataFrame:
    """Rows whose ``answer`` is not valid go to ``ask`` (a function of a DataFrame that replaces answer) once more;
    calls counts the questions."""
    tried = answers.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    again = ask(tried.filter("not _valid").drop("_valid", "answer")).select(*answers.columns)
    return tried.filter("_valid").drop("_valid").withColumn("calls", F.lit(1)).unionByName(again.withColumn("calls", F.lit(2)))


def llm_rows(answers: DataFrame, fields: str, needed: str, defaults: dict[str, str] | None = None) -> DataFrame:
    """C14: rows of the JSON arrays in ``answer`` (key columns kept), those without the needed field left out. Answers
    that are no array give no rows."""
    keys = [c for c in answers.columns if c != "answer"]
    rows = answers.select(*keys, F.inline(F.from_json(json_array("answer"), f"array<struct<{fields}>>"))).filter(F.coalesce(F.col(needed) != "", F.lit(False)))
    return rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (defaults or {}).items()})


#: What stands for a summary that the model did not give.
NO_SUMMARY = {"vi": "[Không thể tạo tóm tắt]", "en": "[Summary unavailable]"}
#: The lists of a report, each with the field without which a row does not count, and its other fields
#: with their defaults. Fields with a numeric default, and timestamp, are numbers.
LISTS = {
    "topics": ("title", {"description": "", "start_time": 0.0, "end_time": 0.0}),
    "action_items": ("task", {"assignee": None, "deadline": None, "priority": "medium", "mentioned_by": None, "timestamp": None}),
    "decisions": ("content", {"made_by": "Team", "timestamp": None}),
}


def report_list(answer, kind: str) -> Column:
    """C14: the rows of one list (LISTS) in a model's answer, in its order. Rows without the needed field go; missing or
    null fields get their defaults, and numbers that cannot be read are null. An answer without an array gives no rows."""
    needed, others = LISTS[kind]
    fields = ", ".join(f"{c}: string" for c in (needed, *others))

    def field(row: Column, name: str, default) -> Column:
        value = row[name].try_cast("double") if name == "timestamp" or isinstance(default, float) else row[name]
        return (value if default is None else F.coalesce(value, F.lit(default))).alias(name)

    each = F.from_json(json_array(answer), "array<string>")  # one by one, so that an entry that is no object harms no other
    rows = F.coalesce(F.transform(each, lambda e: F.from_json(e, f"struct<{fields}>")), F.array().cast(f"array<struct<{fields}>>"))
    named = F.filter(rows, lambda r: F.coalesce(r[needed] != "", F.lit(False)))
    return F.transform(named, lambda r: F.struct(r[needed].alias(needed), *(field(r, c, v) for c, v in others.items())))


def meeting_summaries(texts: DataFrame, ask, language: str = "vi") -> DataFrame:
    """C14: reports of meetings from texts (job_id, text): job_id, summary, topics, action_items, decisions, calls.

    ``ask`` takes (job_id, kind, text), kind being summary or one of LISTS, and adds ``answer`` (null where the model
    failed). All kinds of all meetings are one call of it. A list whose answer holds no JSON array is asked for once more,
    then it stays empty; a summary is asked for once and has a stand-in. ``calls`` counts a meeting's questions. Answers
    are stored before they are read, so no question is put twice because two results need it."""
    kinds = F.explode(F.array(F.lit("summary"), *map(F.lit, LISTS))).alias("kind")
    first = cut_lineage(ask(texts.select("job_id", kinds, F.coalesce("text", F.lit("")).alias("text"))).select("job_id", "kind", "text", "answer"))
    valid = (F.col("kind") == "summary") | F.from_json(json_array("answer"), "array<string>").isNotNull()
    last = cut_lineage(asked_again(first, valid, ask).select("job_id", "kind", "answer", "calls"))
    answers = last.groupBy("job_id").agg(
        F.sum("calls").alias("calls"), *(F.max(F.when(F.col("kind") == k, F.col("answer"))).alias(k) for k in ("summary", *LISTS))
    )
    summary = F.coalesce(T.strip("summary"), F.lit(NO_SUMMARY[language])).alias("summary")
    return answers.select("job_id", summary, *(report_list(k, k).alias(k) for k in LISTS), "calls")


def write_documents(texts: DataFrame, plan, write, reduce, plan_chars: int = 6000, chunk_chars: int = 6000, reduce_chars: int = 8000) -> DataFrame:
    """Documents from texts (doc_id, text): plan, map over chunks, reduce by section.

    ``plan``, ``write`` and ``reduce`` take a DataFrame with prompt columns and add ``answer`` (models stay behind the
    seam): plan once a text on a sample of it (doc_id, sample); write once a chunk (doc_id, chunk, outline, text), for
    all sections at once, as a JSON object of drafts by section id; reduce once a section that has several drafts
    (doc_id, id, heading, text). A single draft is taken as it is; a section without drafts is left out. Blank texts
    give no document and ask nothing. Returns doc_id, content_kind, place, id, heading, kind, markdown, n_drafts.
    """
    live = texts.filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    plans = parsed_plan(plan(live.select("doc_id", T.representative_sample("text", plan_chars).alias("sample")))).select("doc_id", "content_kind", "outline")
    chunks = pack_lines(live.select("doc_id", "text"), chunk_chars).filter(T.strip("text") != "")
    asked = write(chunks.join(plans.select("doc_id", "outline"), "doc_id"))
    drafts = asked.select("doc_id", "chunk", F.explode(F.from_json(json_object("answer"), "map<string,string>")).alias("id", "draft"))
    drafts = drafts.withColumn("draft", T.strip("draft")).filter("draft <> ''")
    sections = plans.select("doc_id", "content_kind", F.posexplode("outline").alias("place", "s")).select("doc_id", "content_kind", "place", "s.*")
    per = drafts.groupBy("doc_id", "id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "draft"))), lambda x: x["draft"]).alias("drafts"))
    filled = sections.join(per, ["doc_id", "id"])
    joined = filled.withColumn("text", bounded_join("drafts", reduce_chars))
    merged = reduce(joined.filter(F.size("drafts") > 1).select("doc_id", "id", "heading", "text")).select("doc_id", "id", F.col("answer").alias("merged"))
    out = filled.join(merged, ["doc_id", "id"], "left").withColumn("markdown", F.coalesce("merged", F.get("drafts", 0)))
    return out.filter(T.strip("markdown") != "").select("doc_id", "content_kind", F.col("place").cast("long").alias("place"), "id", "heading", "kind", "markdown", F.size("drafts").cast("long").alias("n_drafts"))


def leading_heading(c) -> Column:
    """the text of a # heading on the first line that is not blank; null if there is none."""
    line = F.regexp_extract(c, r"^\s*\n? {0,3}#[ \t]+([^\r\n]*)", 1)
    return F.nullif(T.strip(F.regexp_replace(line, r"[ \t]+#+[ \t]*$", "")), F.lit(""))


def document_title(c, fallback) -> Column:
    """the heading, else the fallback, else document; in upper case."""
    return F.upper(F.coalesce(leading_heading(c), F.nullif(T.strip(fallback), F.lit("")), F.lit("document")))


def without_heading(c) -> Column:
    """the text after its leading heading."""
    return F.regexp_replace(F.regexp_replace(c, r"^\s*\n? {0,3}#[ \t]+[^\r\n]*", ""), r"^[\r\n]+", "")


def sections(docs: DataFrame) -> DataFrame:
    """F8: (doc_id, place, heading, body) of texts cut at their ## headings; what comes before the first one has a null
    heading and is left out if blank."""
    parts = F.split("text", r"(?m)^## +")
    rows = docs.select("doc_id", F.posexplode(parts).alias("place", "part"))
    heading = F.when(F.col("place") > 0, T.strip(F.regexp_extract("part", r"^[^\n]*", 0)))
    body = T.strip(F.when(F.col("place") > 0, F.regexp_replace("part", r"^[^\n]*\n?", "")).otherwise(F.col("part")))
    return rows.select("doc_id", F.col("place").cast("long").alias("place"), heading.alias("heading"), body.alias("body")).filter("place > 0 or body <> ''")


def meeting_markdown(meetings: DataFrame, sentences: DataFrame, actions: DataFrame) -> DataFrame:
    """(job_id, report): heading, duration, summary if any, a table of actions if any, the transcript if any.
    ``meetings``: job_id, duration_ms, summary; ``actions``: job_id, ord, task, assignee, priority."""
    line = F.concat(F.lit("`["), T.seconds_to_human("start_ms"), F.lit(" → "), T.seconds_to_human("end_ms"), F.lit("]` "), F.coalesce(F.concat(F.lit("Speaker "), F.col("speaker").cast("string"), F.lit(": ")), F.lit("")), "text", F.lit("  "))
    said = ordered_join(sentences, line, "\n", "said")
    n = F.row_number().over(_by("job_id", "ord"))
    icon = F.create_map(*map(F.lit, ("high", "🔴 Cao", "medium", "🟡 TB", "low", "🟢 Thấp")))
    dash = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("-"))
    row = F.concat(F.lit("| "), F.col("n").cast("string"), F.lit(" | "), "task", F.lit(" | "), dash("assignee"), F.lit(" | "), F.coalesce(icon[F.col("priority")], "priority"), F.lit(" |"))
    table = ordered_join(actions.withColumn("n", n), row, "\n", "todo", by="ord")
    head = F.concat(F.lit("# Báo cáo Cuộc họp\n\n**Thời lượng:** "), T.seconds_to_human("duration_ms"), F.lit("  "))
    part = lambda name, c, lead="": F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"## {name}\n\n{lead}"), c))
    lead = "| # | Công việc | Người phụ trách | Ưu tiên |\n|---|---|---|---|\n"
    joined = meetings.join(said, "job_id", "left").join(table, "job_id", "left")
    return joined.select("job_id", F.concat_ws("\n\n", head, part("Tóm tắt", "summary"), part("Action Items", "todo", lead), part("Transcript", "said")).alias("report"))


def _by(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)
