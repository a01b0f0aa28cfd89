"""Exact substring dedup (operator 9) with two-stage suffix sorting.

Every 50-byte string is dealt to a bucket by its anchor: the least of the hashes of its 16-byte grams. Equal strings
have equal anchors, so a bucket holds all copies of its strings. Runs of positions with one anchor make one context
(their common stretch of text). Contexts are known by digests; only where an anchor has several different ones are they
compared, and only then their texts travel, each one once. Inside a bucket, suffixes smaller than their successors are
sorted directly, the rest are induced by bucket scans, and adjacent common prefixes of 50 bytes show the repeated strings.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import stored, utf8
from ._text import mix64, powers, text_slices

_U = np.uint64
GRAM = 16
#: Bytes of one stretch of text; grams are hashed in blocks whose arrays stay in a core's cache, and a place in a block
#: fits beside a hash in 64 bits.
STRETCH, BLOCK = 1 << 20, 1 << 14
#: An anchor with more contexts than this (in slices; 1.4 MB of text at most) has its strings compared by their digests,
#: not in one bucket.
MOST_CONTEXTS = 16_384
#: A start and a size (which is at most a stretch) in one number.
SPAN = 1 << 21
#: Symbols in one number, symbols compared at least, and symbols beside the number of a group of ties (27 bits).
_PACK, _DEPTH, _STEP = 7, 56, 4


def anchors(buf: np.ndarray, valid: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first position, last position, anchor hash) of the runs of valid positions that share an anchor, and all grams'
    hashes.

    A position stands for the ``length`` bytes from it on; its anchor is the gram of least hash in them, the leftmost
    of equals. ``buf`` has at most STRETCH positions."""
    n = len(buf) - length + 1
    none = np.zeros(0, np.int64)
    if n <= 0 or not valid.any():
        return none, none, np.zeros(0, _U), np.zeros(0, _U)
    place, hashes = np.empty(n, np.int64), np.empty(len(buf) - GRAM + 1, _U)
    span, low = length - GRAM + 1, _U(2 * BLOCK - 1)
    for start in range(0, n, BLOCK):
        part = buf[start : start + BLOCK + length - 1]
        eight = part.astype(_U)
        for step in (1, 2, 4):
            eight = eight[:-step] | (eight[step:] << _U(8 * step))
        own = mix64(eight[: len(part) - GRAM + 1] * _U(0x9E3779B97F4A7C15) + mix64(eight[8:]))
        hashes[start : start + len(own)] = own
        width, least, m = 1, (own & ~low) | np.arange(len(own), dtype=_U), len(part) - length + 1
        while 2 * width <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[:m], least[span - width : span - width + m])
        place[start : start + m] = start + (least[:m] & low).astype(np.int64)
    at = np.flatnonzero(valid[:n])
    new = np.ones(len(at), bool)
    new[1:] = (place[at[1:]] != place[at[:-1]]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(at)) - 1
    return at[heads], at[tails], hashes[place[at[heads]]], hashes


@lru_cache(maxsize=1)
def _weights() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base, and of its inverse modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    return powers(base, STRETCH), powers(pow(base, -1, 1 << 64), STRETCH)


def digests(hashes: np.ndarray, heads: np.ndarray, tails: np.ndarray, length: int) -> np.ndarray:
    """A number for the text of each run, wherever it stands: the weighted sum of the hashes of all its grams."""
    up, down = _weights()
    sums = np.concatenate((np.zeros(1, _U), np.cumsum(hashes * up[: len(hashes)])))
    return mix64((sums[tails + length - GRAM + 1] - sums[heads]) * down[heads] + (tails - heads).astype(_U))


def _stretches(column: pa.Array, length: int):
    """(row of each byte's text, offset of the stretch in its text, bytes, valid positions), at most STRETCH positions
    each; longer texts are cut with an overlap, so that no position is lost."""
    for first, last, buf, offs in text_slices(column, STRETCH - length):
        if last - first == 1 and len(buf) > STRETCH - length:
            step = STRETCH - 2 * length
            for low in range(0, len(buf) - length + 1, step):
                part = buf[low : low + step + length - 1]
                valid = np.ones(len(part), bool)
                valid[max(0, len(part) - length + 1) :] = False
                yield np.full(len(part), first), low, part, valid
            continue
        rows = np.repeat(np.arange(first, last), np.diff(offs))
        ends = np.repeat(offs[1:], np.diff(offs))
        yield rows, None, buf, np.arange(len(buf)) + length <= ends
        del rows, ends


def anchor_counts(source: DataFrame, length: int) -> DataFrame:
    """(h, least, low, high, n, m) by slice: anchors, the least document, the least and the greatest context digest, in
    how many texts and with how many contexts they occur."""
    schema = StructType(StructType.fromDDL("h long").fields + [source.schema.fields[0]] + StructType.fromDDL("low long, high long, n int, m int").fields)

    def work(batches):
        for batch in batches:
            keys = batch.column(0)
            ids = np.asarray(keys)
            for row, _at, h, c, *_ in _found(batch, length):
                order = np.lexsort((row, c, h))
                h, c, row = h[order], c[order], row[order]
                doc = ids[row]
                heads = np.flatnonzero(_first_of(h))
                tails = np.append(heads[1:], len(h)) - 1
                texts, kinds = (np.add.reduceat(x.astype(np.int32), heads) for x in (_first_of(h, c, row), _first_of(h, c)))
                columns = (h[heads], np.minimum.reduceat(doc, heads), c[heads], c[tails], texts, kinds)
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(),) * 4 + (pa.int32(),) * 2, strict=True)], names=schema.names)

    return source.mapInArrow(work, schema).withColumnRenamed(source.columns[0], "least")


def _found(batch: pa.RecordBatch, length: int):
    """By stretch: (row, offset in its text, anchor hash, context digest, its place and size, the stretch) of all runs."""
    for rows, low, buf, valid in _stretches(batch.column(2), length):
        heads, tails, hashes, grams = anchors(buf, valid, length)
        if not len(heads):
            continue
        c, row = digests(grams, heads, tails, length).view(np.int64), rows[heads]
        yield row, heads + low if low is not None else heads - np.searchsorted(rows, row), hashes.view(np.int64), c, heads, tails - heads + length, buf


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Marks the rows whose keys differ from those of the row before."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return new


def anchored_runs(source: DataFrame, length: int) -> DataFrame:
    """(h, c, doc_id, t, place): contexts of anchors, c being a digest of the context, place its start and size.

    Where texts of one slice have equal contexts, the least document goes on; in the others every byte of the context is
    repeated, so their merged spans come as rows with a null c and a spread-out h. So a passage that very many documents
    share is one row a slice."""
    schema = StructType(StructType.fromDDL("h long, c long").fields + source.schema.fields[:2] + StructType.fromDDL("place long").fields)

    def work(batches):
        for batch in batches:
            keys, marks = batch.column(0), batch.column(1)
            ids, tells = np.asarray(keys), np.asarray(marks)
            for row, at, h, c, _place, size, _buf in _found(batch, length):
                order = np.lexsort((at, tells[row], ids[row], c, h))
                row, at, h, c, size = (x[order] for x in (row, at, h, c, size))
                doc = ids[row]
                group = _first_of(h, c)
                own = doc == doc[np.flatnonzero(group)][np.cumsum(group) - 1]
                kept = row[own]
                yield pa.RecordBatch.from_arrays([pa.array(h[own]), pa.array(c[own]), keys.take(pa.array(kept)), marks.take(pa.array(kept)), pa.array(at[own] * SPAN + size[own])], names=schema.names)
                if own.all():
                    continue
                row, at, size = row[~own], at[~own], size[~own]
                order = np.lexsort((at, row))
                row, at, end = row[order], at[order], (at + size)[order]
                base = (row - row[0]) * (1 << 40)  # spans of different rows never touch
                s, e = merged(base + at, base + end)
                row = row[np.searchsorted(base + at, s)]
                shift = (row - row[0]) * (1 << 40)
                spread = mix64((ids[row].astype(_U) << _U(20)) ^ s.astype(_U)).view(np.int64)
                nothing = pa.nulls(len(s)).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(spread), nothing, keys.take(pa.array(row)), marks.take(pa.array(row)), pa.array((s - shift) * SPAN + e - s)], names=schema.names)

    return source.mapInArrow(work, schema)


def _packed(symbols: np.ndarray) -> np.ndarray:
    """Seven symbols of nine bits from each position on, as one number (zeros follow the end)."""
    key = np.zeros(len(symbols), _U)
    wide = np.concatenate((symbols, np.zeros(_PACK, symbols.dtype)))
    for k in range(_PACK):
        key = (key << _U(9)) | wide[k : k + len(symbols)].astype(_U)
    return key


def _sorted_directly(at: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Suffixes ``at`` in the order of at least their first _DEPTH symbols; only ties are compared further."""
    deep = np.concatenate((packed, np.zeros(_DEPTH + _STEP, _U)))
    at = at[np.argsort(packed[at])]
    same = packed[at[1:]] == packed[at[:-1]]
    for depth in range(_PACK, _DEPTH, _STEP):
        tied = np.zeros(len(at), bool)
        tied[1:] |= same
        tied[:-1] |= same
        where = np.flatnonzero(tied)
        if not len(where):
            break
        group = np.cumsum(np.concatenate(([True], ~same)), dtype=_U)[where]
        key = (group << _U(9 * _STEP)) | (deep[at[where] + depth] >> _U(9 * (_PACK - _STEP)))
        order = np.argsort(key)
        at[where] = at[where][order]
        key, joined = key[order], np.diff(where) == 1
        same[where[:-1][joined]] &= (key[1:] == key[:-1])[joined]
    return at


def two_stage_order(symbols: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """The suffixes of ``symbols`` (0..256) in the order of at least their first 56 symbols.

    Stage one sorts the suffixes smaller than their successor. Stage two goes through the buckets of equal first
    symbols upwards: a suffix greater than its successor follows in the order in which its successor was met."""
    n = len(symbols)
    if not n:
        return np.zeros(0, np.int64)
    change = np.flatnonzero(symbols[:-1] != symbols[1:])
    rises = symbols[change] < symbols[change + 1]
    run = np.concatenate(([0], np.cumsum(symbols[:-1] != symbols[1:])))
    small = np.append(rises, False)[run]  # smaller than its successor; the last run is greater than the empty suffix
    direct = np.flatnonzero(small)
    direct = _sorted_directly(direct, packed)
    first = np.searchsorted(symbols[direct], np.arange(258))
    pending: list[list[np.ndarray]] = [[] for _ in range(257)]
    pending[symbols[-1]].append(np.array([n - 1]))
    out = []
    for symbol in range(257):
        parts = pending[symbol]
        new = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        found = [new]
        while len(new):  # predecessors in a run of this very symbol
            new = new[new > 0] - 1
            new = new[(symbols[new] == symbol) & ~small[new]]
            found.append(new)
        bucket = np.concatenate([*found, direct[first[symbol] : first[symbol + 1]]])
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[symbols[before] > symbol]
        before = before[np.argsort(symbols[before], kind="stable")]
        if len(before):
            cuts = np.flatnonzero(np.diff(symbols[before])) + 1
            for part in np.split(before, cuts):
                pending[symbols[part[0]]].append(part)
    return np.concatenate(out)


def shared_prefix(symbols: np.ndarray, packed: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """For each of ``at`` but the first: is its common prefix with the one before at least ``length`` symbols?"""
    same = np.ones(max(len(at) - 1, 0), bool)
    low, high = at[:-1], at[1:]
    for k in range(0, length - _PACK + 1, _PACK):
        on = np.flatnonzero(same)
        same[on] = packed[low[on] + k] == packed[high[on] + k]
    for k in range(length - length % _PACK, length):
        on = np.flatnonzero(same)
        same[on] = symbols[low[on] + k] == symbols[high[on] + k]
    return same


def least_documents(texts: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For all strings of ``length`` bytes in all contexts, in order: context, and the least document with the string."""
    sizes = np.array([len(x) for x in texts], np.int64)
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    symbols = raw.astype(np.uint16) + np.uint16(1)
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = 0
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    valid = np.arange(len(raw)) + length <= ends[owner]
    packed = _packed(symbols)
    order = two_stage_order(symbols, packed)
    order = order[valid[order]]
    new = np.ones(len(order), bool)
    new[1:] = ~shared_prefix(symbols, packed, order, length)
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(docs[owner[order]], heads) if len(order) else docs[:0]
    by_place = np.zeros(len(raw), docs.dtype)
    by_place[order] = least[np.cumsum(new) - 1]
    return owner[valid], by_place[valid]


def bucket_results(rows: DataFrame, buckets: int, length: int) -> DataFrame:
    """(h, c, opens, closes, least): runs of string starts in each distinct context, with the least document."""
    keyed = rows.select(F.pmod(F.xxhash64("h"), F.lit(buckets)).cast("int").alias("bucket"), "h", "c", F.col("least").alias("doc_id"), "ctx")

    def work(table: pa.Table) -> pa.Table:
        h, c, doc = (np.asarray(table.column(k).combine_chunks()) for k in ("h", "c", "doc_id"))
        texts = table.column("ctx").combine_chunks().to_pylist()
        order = np.lexsort((doc, c, h))
        order = order[_first_of(h[order], c[order])]  # a text in two stretches or rows gives a context twice
        owner, least = least_documents([texts[i] for i in order], doc[order], length)
        heads = np.flatnonzero(_first_of(owner, least))
        tails = np.append(heads[1:], len(owner))
        base = np.searchsorted(owner, np.arange(len(order)))
        cut = np.searchsorted(owner[heads], np.arange(len(order) + 1)).astype(np.int32)
        lists = [heads - base[owner[heads]], tails - base[owner[heads]] - 1 + length, least[heads]]
        return pa.table([pa.array(h[order]), pa.array(c[order]), *(pa.ListArray.from_arrays(pa.array(cut), pa.array(x.astype(np.int64))) for x in lists)], names=["h", "c", "opens", "closes", "least"])

    return keyed.groupBy("bucket").applyInArrow(work, "h long, c long, opens array<long>, closes array<long>, least array<long>")


def frequent_results(rows: DataFrame, length: int) -> DataFrame:
    """What ``bucket_results`` gives, for anchors with so many contexts that no task should hold them: each string of a
    context goes its own way by its 64-bit digest (within the anchor's 64 bits), its documents' minimum taken before
    the shuffle."""
    place = F.explode(F.sequence(F.lit(0), F.octet_length("ctx") - length)).alias("i")
    strings = rows.select("h", "c", "least", "ctx", place).select("h", "c", "least", "i", F.xxhash64(F.substring("ctx", F.col("i") + 1, F.lit(length))).alias("s"))
    firsts = strings.groupBy("h", "s").agg(F.min("least").alias("first"))
    pieces = strings.select("h", "c", "i", "s").distinct().join(firsts, ["h", "s"]).groupBy("h", "c").agg(F.sort_array(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "first"))).alias("p"))
    return pieces.select("h", "c", F.col("p.i").alias("opens"), F.transform("p", lambda x: x["i"] + length).alias("closes"), F.col("p.first").alias("least"))


def repeated_spans(docs: DataFrame, length: int = 50, bucket_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, t, spans): by text, the sorted [start, end) bytes that stand in strings of ``length`` bytes which also
    start in a document of smaller doc_id. Spans may overlap. Texts without any are left out; t tells the texts of one
    doc_id apart.

    Texts whose contexts of an anchor are all equal need no sorting: the whole context repeats. Contexts that differ
    meet in the anchor's bucket and are compared by their sorted suffixes. What is shuffled is digests and places, and
    the texts once; every step is the same plan at every size, and a frequent anchor's rows are summed up by slice
    before they are counted, joined by joins that may be split, and compared string by string."""
    source = docs.select("doc_id", _tell("text").alias("t"), utf8("text").alias("text")).filter(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    counts = anchor_counts(source, length).groupBy("h").agg(F.min("least").alias("least"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum("m").alias("m"))
    shared = stored(counts.filter("n > 1").select("h", "least", F.expr("low < high").alias("mixed"), (F.col("m") > MOST_CONTEXTS).alias("often")), "anchors")
    runs = anchored_runs(source, length).join(shared, "h", "left").filter("c is null or mixed or doc_id > least")
    place = {"at": F.expr(f"place div {SPAN}"), "size": F.expr(f"place % {SPAN}")}
    runs = stored(runs.drop("least").fillna(False, ["mixed", "often"]), "runs").withColumns(place).drop("place")
    mixed = runs.filter("mixed")
    total = mixed.filter("not often").agg(F.sum("size")).first()[0] or 0
    wanted = mixed.groupBy("h", "c", "often").agg(F.min(F.struct("doc_id", "t", "at", "size")).alias("first")).select("h", "c", "often", "first.*")
    context = F.substring("text", (F.col("at") + 1).cast("int"), F.col("size").cast("int"))
    texts = stored(wanted.join(source, ["doc_id", "t"]).select("h", "c", "often", F.col("doc_id").alias("least"), context.alias("ctx")), "texts")
    results = bucket_results(texts.filter("not often"), max(8, -(-total // bucket_bytes)), length).unionByName(frequent_results(texts.filter("often"), length))
    results = stored(results, "results")
    pieces = F.filter(F.arrays_zip("opens", "closes", "least"), lambda x: x["least"] < F.col("doc_id"))
    hits = (
        mixed.join(results, ["h", "c"]).select("doc_id", "t", "at", F.explode(pieces).alias("p"))
        .select("doc_id", "t", (F.col("at") + F.col("p.opens")).alias("s"), (F.col("at") + F.col("p.closes")).alias("e"))
    )
    whole = runs.filter("not mixed").select("doc_id", "t", F.col("at").alias("s"), (F.col("at") + F.col("size")).alias("e"))
    return whole.unionByName(hits).groupBy("doc_id", "t").agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("spans"))


def _tell(text: str) -> F.Column:
    """Tells the texts of one doc_id apart."""
    return F.hash(F.coalesce(F.col(text), F.lit("")))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of covered bytes of spans sorted by start; touching spans are one run."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    heads = np.flatnonzero(new)
    return starts[heads], reach[np.append(heads[1:], len(starts)) - 1]


def substring_dedup(docs: DataFrame, length: int = 50, spans: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id: bigint, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes
    that stay).

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller doc_id; strings are
    judged on the input, never cross documents, and repeats inside one document alone stay. Texts are UTF-8 bytes; a
    null text is empty. Shorter texts lose nothing. Rows that repeat a doc_id are one document; each of its
    texts is judged against documents of smaller doc_id. A null doc_id stays whole. Other columns are not read.
    """
    spans = repeated_spans(docs, length) if spans is None else spans
    flat = spans.select("doc_id", "t", F.col("spans.s").alias("starts"), F.col("spans.e").alias("ends"))
    joined = docs.select("doc_id", _tell("text").alias("t"), utf8("text").alias("text")).join(flat, ["doc_id", "t"], "left").drop("t")
    schema = StructType(joined.schema.fields[:1] + StructType.fromDDL("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary").fields)

    def work(batches):
        for batch in batches:
            columns = [[] for _ in range(5)]
            for text, starts, ends in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
                data = text.as_py()
                a, b = (np.zeros(0, np.int64) if not x.is_valid else np.asarray(x.values) for x in (starts, ends))
                a, b = merged(a, np.minimum(b, len(data)))
                edges = [0, *np.stack((a, b), 1).ravel().tolist(), len(data)]
                kept = b"".join(data[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
                for column, x in zip(columns, (len(data), len(data) - len(kept), len(a), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=schema.names)

    return joined.mapInArrow(work, schema)
