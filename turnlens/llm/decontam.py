"""Benchmark decontamination (operator 6): SimHash of item-sized windows, multi-index Hamming blocks, exact check."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._shared import stored, utf8
from ._text import shingle_hashes, text_slices, word_hashes, word_spans

_U = np.uint64
#: Blocks of a fingerprint; windows, and pairs of a window's hit and an item, that are handled at once.
BLOCKS, RUN, LISTED = 8, 1024, 1 << 20
_POP = np.array([bin(i).count("1") for i in range(256)], np.int64)


def _signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of the 64 bits of each hash."""
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int8) * 2 - 1


class Benchmark:
    """The items of one block of the benchmark, indexed: shingles, weights, and fingerprints by window size.

    Items of the same shingles are one entry. An entry is looked up by its rarest shingles only, the prefix: those that
    all others together cannot make up for. A window that is similar enough shares at least the threshold's part of the
    item's weight, so it holds one of them; phrases that many items share are in no prefix, however many share them.
    """

    def __init__(self, items: list[tuple[int, bytes]], size: int, radius: int, threshold: float):
        self.size, self.radius, self.threshold = size, radius, threshold
        found: dict[tuple[bytes, bytes], set[int]] = defaultdict(set)
        for item, text in items:
            buf = np.frombuffer(text, np.uint8)
            starts, ends = word_spans(buf, np.array([0, len(buf)]))
            shingles = shingle_hashes(word_hashes(buf, starts, ends, fold_case=True), size)
            if len(shingles):
                hashes, times = np.unique(shingles, return_counts=True)
                found[hashes.tobytes(), times.tobytes()].add(item)
        #: By entry: the ids of its items, and its distinct shingles with how often each comes.
        self.ids = [sorted(k) for k in found.values()]
        self.sets = [(np.frombuffer(h, _U), np.frombuffer(n, np.int64)) for h, n in found]
        df: dict[int, int] = defaultdict(int)
        for (hashes, _), ids in zip(self.sets, self.ids, strict=True):
            for h in hashes.tolist():
                df[h] += len(ids)
        self.shingles = np.array(sorted(df), _U)
        #: A shingle of several items says less about each of them; one of no item weighs like one of a single item.
        self.weights = 1.0 / np.array([df[h] for h in self.shingles.tolist()], float)
        sizes = [int(n.sum()) for _, n in self.sets]
        self.by_size, owners = {}, defaultdict(lambda: defaultdict(list))
        for m in sorted(set(sizes)):
            members = [k for k, n in enumerate(sizes) if n == m]
            prints = np.stack([self.fingerprint(*self.sets[k]) for k in members])
            near = np.zeros((BLOCKS, 256, len(members)), bool)  # by block and value: items within radius // BLOCKS bits
            for b in range(BLOCKS):
                near[b] = _POP[np.arange(256)[:, None] ^ prints[None, :, b].astype(np.int64)] <= radius // BLOCKS
            self.by_size[m] = (members, prints, near)
            for at, k in enumerate(members):
                for h in self.prefix(*self.sets[k]):
                    owners[h][m].append(at)
        #: By place of a shingle and size: the entries of that size that have it in their prefix.
        self.owners = [{m: np.array(at) for m, at in owners[h].items()} if h in owners else {} for h in self.shingles.tolist()]
        self.leads = np.array([bool(o) for o in self.owners], bool)

    def _weights(self, hashes: np.ndarray) -> np.ndarray:
        return self.weights[np.searchsorted(self.shingles, hashes)]

    def prefix(self, hashes: np.ndarray, times: np.ndarray) -> list[int]:
        """The item's rarest shingles, so many that the others weigh less than the threshold's part of the item."""
        weights = self._weights(hashes)
        order = np.lexsort((hashes, -weights))
        rest = np.cumsum((weights * times)[order][::-1])[::-1]  # what a shingle and all after it weigh
        return hashes[order][rest >= self.threshold * rest[0] - 1e-9].tolist()

    def fingerprint(self, hashes: np.ndarray, times: np.ndarray) -> np.ndarray:
        return np.packbits((times * self._weights(hashes)) @ _signs(hashes) > 0)

    def similarities(self, k: int, places: np.ndarray, hashes: np.ndarray, weights: np.ndarray, wide: int) -> np.ndarray:
        """Weighted Jaccard of entry k and the windows at ``places``: shared weight over joint weight, with
        multiplicities. ``hashes``, ``weights``: those of all shingles of the text."""
        mine, times = self.sets[k]
        own = self._weights(mine)
        out = [np.zeros(0)]
        for some in np.split(places, range(LISTED // wide + 1, len(places), LISTED // wide + 1)):
            cells = some[:, None] + np.arange(wide)[None, :]
            at = np.minimum(np.searchsorted(mine, hashes[cells]), len(mine) - 1)
            rows, cols = np.nonzero(mine[at] == hashes[cells])
            told, counts = np.unique(rows * len(mine) + at[rows, cols], return_counts=True)
            rows, at = np.divmod(told, len(mine))
            shared = np.bincount(rows, np.minimum(counts, times[at]) * own[at], minlength=len(some))
            out.append(shared / ((times * own).sum() + weights[cells].sum(axis=1) - shared))
        return np.round(np.concatenate(out), 12)  # so that equal windows are equal, and the first is the best

    def matches(self, shingles: np.ndarray, hits: np.ndarray) -> dict[int, tuple[float, int, int, int]]:
        """By entry: (similarity, minus start, window's shingles, Hamming distance) of the best window of one text.

        ``hits``: positions of benchmark shingles. Windows are fingerprinted where they hold a prefix shingle of an item
        of their size, and looked up for such items only, a bounded number of hits and items at a time."""
        at = np.searchsorted(self.shingles, shingles[hits])
        low, high = 0, len(shingles)
        weights = np.ones(high)
        weights[hits] = self.weights[at]
        reach = defaultdict(list)
        for p, k in zip(hits[self.leads[at]].tolist(), at[self.leads[at]].tolist(), strict=True):
            for m, items in self.owners[k].items():
                reach[m].append((p, items))
        best: dict[int, tuple[float, int, int, int]] = {}
        for m, found in reach.items():
            wide, places = min(m, high - low), np.array([p for p, _ in found])
            opens = np.unique(np.clip((places[:, None] - np.arange(wide)[None, :]).ravel(), 0, high - wide))
            listed = np.concatenate([[0], np.cumsum([len(items) for _, items in found])])
            load = np.cumsum(listed[np.searchsorted(places, opens + wide)] - listed[np.searchsorted(places, opens)]) // LISTED
            cuts = np.flatnonzero((np.diff(opens) > 4 * wide) | (np.diff(load) > 0)) + 1
            members, prints, near = self.by_size[m]
            for whole in np.split(opens, cuts):
                for run in np.split(whole, range(RUN, len(whole), RUN)):
                    a, b = run[0], run[-1] + wide
                    sums = np.zeros((b - a + 1, 64))
                    np.cumsum(_signs(shingles[a:b]) * weights[a:b, None], axis=0, out=sums[1:])
                    marks = np.packbits(sums[run - a + wide] - sums[run - a] > 1e-9, axis=1)
                    codes = [np.zeros(0, np.int64)]
                    for p, items in found[np.searchsorted(places, a) : np.searchsorted(places, b)]:
                        first, last = np.searchsorted(run, (p - wide + 1, p + 1))
                        codes.append((items[:, None] * len(run) + np.arange(first, last)[None, :]).ravel())
                    cols, rows = np.divmod(np.unique(np.concatenate(codes)), len(run))
                    seen = np.zeros(len(rows), bool)
                    for block in range(BLOCKS):
                        seen |= near[block][marks[rows, block], cols]
                    rows, cols = rows[seen], cols[seen]
                    apart = _POP[marks[rows] ^ prints[cols]].sum(axis=1)
                    rows, cols, apart = (x[apart <= self.radius] for x in (rows, cols, apart))
                    ends = np.flatnonzero(np.diff(cols, append=-1)) + 1
                    for i, j in zip([0, *ends.tolist()], ends.tolist(), strict=False):
                        k = members[cols[i]]
                        alike = self.similarities(k, run[rows[i:j]], shingles, weights, wide)
                        top = int(np.argmax(alike))
                        got = (float(alike[top]), -int(run[rows[i + top]]), wide, int(apart[i + top]))
                        if got[0] >= self.threshold and got > best.get(k, (0.0,)):
                            best[k] = got
        return best


def _blocks(benchmark: DataFrame, block_items: int) -> Iterator[list[tuple[int, bytes]]]:
    """The benchmark, a stated query set, in blocks of a bounded number of items, one at a time."""
    rows = benchmark.select("item_id", utf8("text").alias("text")).filter("item_id is not null").distinct()
    count = rows.count()
    n = -(-count // block_items)
    parts = 1 if n <= 1 else 2 * n
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))
    for k in range(parts if count else 0):
        yield [(r[0], bytes(r[1])) for r in rows.filter(part == k).collect()]


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, size: int = 5, radius: int = 22, block_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, start_word, end_word, hamming, similarity): the best window of each document for each
    benchmark item that it contains.

    A window is as long as the item (the whole text where that is shorter). It counts if the weighted Jaccard
    similarity of the ``size``-word shingles (A-Z folded, multiplicities, 1 / number of items as the weight) is at
    least ``threshold``. Candidates are windows whose 64-bit SimHash is within ``radius`` bits of the item's: with
    eight blocks of 8 bits, one block is within radius // 8 bits, and the block tables tell all such items among those
    that share a shingle with the window. Items and
    texts of fewer than ``size`` words match nothing; null texts count as empty. A document id that repeats gives its
    rows for each copy. The benchmark is a query set handled in blocks of at most about ``block_items`` items, each
    block one pass over the documents whose result is stored, so what the driver and the tasks hold has that bound.
    Other columns are not read; an empty table or benchmark gives an empty result.
    """
    source = docs.select(F.col("doc_id"), utf8("text").alias("text"))
    schema = StructType(source.schema.fields[:1] + StructType.fromDDL("item_id long, start_word long, end_word long, hamming long, similarity double").fields)
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, block_items):
        index = docs.sparkSession.sparkContext.broadcast(Benchmark(items, size, radius, threshold))

        def work(batches, index=index):
            bench = index.value
            for batch in batches:
                rows, found = [], []
                for first, _last, buf, offs in text_slices(batch.column(1)):
                    starts, ends = word_spans(buf, offs)
                    words = word_hashes(buf, starts, ends, fold_case=True)
                    if not len(bench.shingles) or len(words) < size:
                        continue
                    shingles = shingle_hashes(words, size)
                    at = np.searchsorted(bench.shingles, shingles)
                    hits = np.flatnonzero(bench.shingles[np.minimum(at, len(bench.shingles) - 1)] == shingles)
                    cut = np.searchsorted(starts, offs)
                    owner = np.searchsorted(cut, hits, side="right") - 1
                    hits, owner = (x[hits + size <= cut[owner + 1]] for x in (hits, owner))
                    for i in np.unique(owner):
                        own = shingles[cut[i] : cut[i + 1] - size + 1]
                        for k, (sim, start, wide, apart) in bench.matches(own, hits[owner == i] - cut[i]).items():
                            rows += [first + int(i)] * len(bench.ids[k])
                            found += [(item, -start, -start + wide + size - 1, apart, sim) for item in bench.ids[k]]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                kinds = (pa.int64(),) * 4 + (pa.float64(),)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *map(pa.array, columns, kinds)], names=schema.names)

        out = out.unionByName(stored(source.mapInArrow(work, schema), "found"))
        index.destroy()
    return out
