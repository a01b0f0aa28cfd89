"""Substring dedup (operator 8): content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import stored, utf8
from ._text import mix64, text_slices

#: A cut falls after a byte whose gear hash has these five bits zero (one byte in 32); they depend on the 24 bytes
#: before, so boundaries settle again 24 bytes after an insertion. Chunks have 8 to 1024 bytes (the last may be less).
MASK, LEAST, MOST = np.uint32(0x1F << 19), 8, 1024
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)


def gear_hashes(buf: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: shifted sums of byte codes, doubled five times to 32 bytes."""
    h = _GEAR[buf]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            h = np.concatenate((h[:step], h[step:] + (h[:-step] << np.uint32(step))))
    return h


def chunk_ends(data: np.ndarray, marked: np.ndarray) -> list[int]:
    """Ends of the chunks of one text: the marked places, at least LEAST and at most MOST bytes apart."""
    out, last, n = [], 0, len(data)
    for end in [*marked.tolist(), n]:
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end - last >= LEAST and end < n:
            out.append(last := end)
    if n > last:
        out.append(n)
    return out


def _cut(batch: pa.RecordBatch):
    """By slice: (rows, at, size, digests as pairs of 64 bits) of all chunks of whole texts. Empty texts have none."""
    for first, _last, buf, offs in text_slices(batch.column(2)):
        rows, at, size, digests = [], [], [], []
        for i in range(len(offs) - 1):
            data = buf[offs[i] : offs[i + 1]]
            ends = chunk_ends(data, np.flatnonzero((gear_hashes(data) & MASK) == 0) + 1)
            raw, low = data.tobytes(), 0
            for end in ends:
                at.append(low)
                size.append(end - low)
                digests.append(xxhash.xxh3_128_digest(raw[low:end]))
                low = end
            rows.append(np.full(len(ends), first + i))
        pair = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield np.concatenate(rows), np.array(at, np.int64), np.array(size, np.int32), pair[:, 0].copy(), pair[:, 1].copy()


def _groups(ids: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows in the order of digest and document, and where each digest starts among them."""
    order = np.lexsort((ids, d2, d1))
    new = np.ones(len(order), bool)
    new[1:] = (d1[order][1:] != d1[order][:-1]) | (d2[order][1:] != d2[order][:-1])
    return order, np.flatnonzero(new)


def first_documents(source: DataFrame) -> DataFrame:
    """(d1, d2, first, last) by slice: the digests of chunks, and the least and the greatest document with the chunk."""

    def work(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for rows, _at, _size, d1, d2 in _cut(batch):
                if len(rows):
                    order, heads = _groups(ids[rows], d1, d2)
                    doc, tails = ids[rows][order], np.append(heads[1:], len(order)) - 1
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d1[order][heads], d2[order][heads], doc[heads], doc[tails])], names=["d1", "d2", "first", "last"])

    return source.mapInArrow(work, "d1 long, d2 long, first long, last long")


def chunks(source: DataFrame) -> DataFrame:
    """(doc_id, t, at, size, d1, d2, known): all chunks; known if a smaller document of the same slice has the chunk.
    Known ones need no lookup; their d1 is spread out, so that a very common chunk does not meet in one task."""
    schema = StructType(source.schema.fields[:2] + StructType.fromDDL("at long, size int, d1 long, d2 long, known boolean").fields)

    def work(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for rows, at, size, d1, d2 in _cut(batch):
                if len(rows):
                    order, heads = _groups(ids[rows], d1, d2)
                    least = np.repeat(ids[rows][order][heads], np.diff(np.append(heads, len(order))))
                    known = np.zeros(len(rows), bool)
                    known[order] = ids[rows][order] > least
                    d1[known] = mix64(ids[rows][known].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + at[known].astype(np.uint64)).view(np.int64)
                    at_row = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at_row), batch.column(1).take(at_row), *map(pa.array, (at, size, d1, d2, known))], names=schema.names)

    return source.mapInArrow(work, schema)


def repeated_passages(docs: DataFrame, least_run: int = 96) -> DataFrame:
    """(doc_id, t, n_spans, n_removed, spans): by text, the passages that a document of smaller doc_id has too.

    spans: array of (start, end) in bytes of the UTF-8 text: runs of adjacent chunks whose digests occur in a smaller
    doc_id, if a run has ``least_run`` bytes or more, so that single common phrases stay. Texts without such a passage
    (also null and empty texts and null ids) are left out. The smallest doc_id keeps its copy, repeats inside one
    document stay. Rows that repeat a doc_id are one document; t (hash of the text) tells its texts apart, and rows
    equal in both share their result. An empty table gives an empty result; columns other than doc_id and text are not
    read. Digests are summed up by slice before the shuffle, and of a chunk that many documents of a slice share only
    the least one is looked up, so a very common chunk is one row a slice on either side.
    """
    source = docs.filter("doc_id is not null").select("doc_id", F.hash(F.coalesce("text", F.lit(""))).alias("t"), utf8("text").alias("text"))
    firsts = first_documents(source).groupBy("d1", "d2").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter("first < last").drop("last")
    again = chunks(source).join(stored(firsts, "digests"), ["d1", "d2"], "left").filter("known or doc_id > first")
    runs = again.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("at", (F.col("at") + F.col("size")).alias("end")))).alias("hits"))
    # adjacent chunks: a run starts where no chunk ends at its start
    starts = F.array_except(F.col("hits.at"), F.col("hits.end"))
    ends = F.array_except(F.col("hits.end"), F.col("hits.at"))
    spans = F.filter(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda x: x["end"] - x["start"] >= least_run)
    return (
        runs.select("doc_id", "t", spans.alias("spans"))
        .filter(F.size("spans") > 0)
        .select(
            "doc_id",
            "t",
            F.size("spans").cast("long").alias("n_spans"),
            F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"]).alias("n_removed"),
            "spans",
        )
    )


def remove_passages(docs: DataFrame, least_run: int = 96) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text``; a character cut in part goes with its passage."""
    found = repeated_passages(docs.select("doc_id", "text"), least_run).select(F.col("doc_id").alias("doc"), F.col("t"), F.col("spans"))
    same = (docs["doc_id"] == found["doc"]) & (F.hash(F.coalesce(docs["text"], F.lit(""))) == found["t"])
    joined = docs.join(found, same, "left").select(*[docs[c] for c in docs.columns], found["spans"].alias("spans"))
    names, place, width = docs.columns, docs.columns.index("text"), len(docs.columns)

    def work(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(place).to_pylist(), batch.column(width).to_pylist(), strict=True):
                if spans and text is not None:
                    data, at, parts = text.encode(), 0, []
                    for span in spans:
                        parts.append(data[at : span["start"]])
                        at = span["end"]
                    text = "".join(p.decode("utf-8", "ignore") for p in (*parts, data[at:]))
                texts.append(text)
            columns = list(batch.columns[:-1])
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.toDF(*[f"c{k}" for k in range(width)], "spans").mapInArrow(work, docs.schema)
