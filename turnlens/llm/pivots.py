"""Embedding near-duplicates by a pivot-permutation index (operator 11).

Every vector is described by its nearest reference points (pivots), in order. Two vectors are compared if they share
enough of them: inverted lists hold the vectors by pairs of pivots, shared pivots are counted in a list, and what shares
enough is verified by cosine in double precision.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._graph import components
from ._shared import stored

#: Vectors that pivots are chosen from at most, pivots, how many describe a vector, and how many two must share.
SAMPLE, PIVOTS, NEAREST, SHARED = 4096, 512, 9, 3
#: Rows of a list that are compared at once; a longer list is cut into blocks, and each pair of blocks is a group.
BLOCK = 1024
#: Groups of up to so many rows are compared pair by pair, so many pairs at a time; larger ones as matrices.
SMALL, PAIRS = 48, 100_000


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision (first scaled, so that no square overflows)."""
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True, initial=0)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, dim: int, pivots: int = PIVOTS, most: float = 0.7) -> np.ndarray:
    """The sample's vectors that are farthest from those already chosen (the first one first), as long as no two are
    more alike than ``most``, so that near copies are not told apart by chance; then random directions (fixed seed)."""
    chosen = []
    if len(sample):
        nearest, at = np.full(len(sample), -1.0), 0
        while len(chosen) < pivots and nearest[at] <= most:
            chosen.append(sample[at])
            nearest = np.maximum(nearest, sample @ sample[at])
            at = int(nearest.argmin())
    rest = np.random.default_rng(11).normal(size=(pivots - len(chosen), dim))
    return np.concatenate([np.array(chosen).reshape(-1, dim), rest / np.linalg.norm(rest, axis=1, keepdims=True)])


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column whose rows are all of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def distinct_vectors(table: DataFrame) -> DataFrame:
    """(label, dim, d1, d2, key, n, vec): distinct vectors by label with their smallest vec_id and the number of vec_ids.
    Vectors and their labels are known by a 128-bit digest."""
    return (
        table.groupBy("label", "dim", "d1", "d2")
        .agg(F.min("vec_id").alias("key"), F.count_distinct("vec_id").alias("n"), F.any_value("embedding").alias("vec"))
    )


def usable(table: DataFrame) -> DataFrame:
    """The rows with an id, a label and a vector that is not null, not zero and all finite; with ``dim`` and digests."""
    e = F.col("embedding")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    rows = table.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & e.isNotNull()).filter(finite)
    return rows.select("vec_id", "label", "embedding", F.size("embedding").alias("dim"), F.xxhash64("label", "embedding").alias("d1"), F.xxhash64("embedding", "label").alias("d2"))


def fit(vectors: DataFrame, sample: int = SAMPLE, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots by dimension, from the ``sample`` vectors with the least digests; a dimension that is not among them gets
    random directions. What the driver holds is bounded by ``sample``."""
    rows = vectors.orderBy("d1", "d2", "label").select("dim", "vec").limit(sample).collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r["dim"], []).append(r["vec"])
    return {dim: choose_pivots(unit(np.array(v)), dim, pivots) for dim, v in found.items()}


def describe(vectors: DataFrame, fitted: dict[int, np.ndarray], pivots: int = PIVOTS, nearest: int = NEAREST) -> DataFrame:
    """``vectors`` with ``pivots``: the numbers of the ``nearest`` pivots, nearest first (ties by number)."""
    schema = StructType([*vectors.schema.fields, *StructType.fromDDL("pivots array<short>").fields])

    def work(batches):
        for batch in batches:
            dims, vec = batch.column(batch.schema.get_field_index("dim")).to_numpy(), batch.column(batch.schema.get_field_index("vec"))
            out = np.zeros((len(dims), min(nearest, pivots)), np.int16)
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                points = fitted.get(int(dim))
                points = choose_pivots(np.zeros((0, dim)), int(dim), pivots) if points is None else points
                for some in np.array_split(at, -(-len(at) // 2048)):
                    near = unit(_matrix(vec.take(pa.array(some)))) @ points.T
                    out[some] = np.argsort(-near, axis=1, kind="stable")[:, : out.shape[1]]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(dims) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "pivots"])

    return vectors.mapInArrow(work, schema)


def inverted_lists(described: DataFrame, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED) -> DataFrame:
    """(label, dim, d1, key, n, vec, ranked, lists): every vector with the pairs of pivots whose lists it is in.

    Pivots are in one order, rare ones first. Of two vectors that share ``shared`` pivots or more, the first two shared
    ones are among the first nearest - shared + 2 on either side: at most shared - 2 shared ones come after them. So
    these pairs lose no candidate, and the pair of the first two shared pivots names the one list in which it counts.
    """
    counts = dict(described.select(F.explode("pivots").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect())
    order = sorted(range(pivots), key=lambda p: (counts.get(p, 0), p))
    rank = F.array(*[F.lit(k) for _, k in sorted((p, k) for k, p in enumerate(order))])
    ranked = F.array_sort(F.transform("pivots", lambda p: F.get(rank, p.cast("int"))))
    pairs = [F.get("ranked", F.lit(a)) * pivots + F.get("ranked", F.lit(b)) for a, b in combinations(range(nearest - shared + 2), 2)]
    return stored(described.withColumn("ranked", ranked), "described").select("label", "dim", "d1", "key", "n", "vec", "ranked", F.array(*pairs).alias("lists"))


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (a < b) of rows of each group, given the sizes of groups that follow each other."""
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    b = np.repeat(np.arange(len(place)), place)
    a = np.arange(len(b)) - np.repeat(np.cumsum(place) - place, place) + (b - np.repeat(place, place))
    return a, b


def _first_two(ranks_a: np.ndarray, ranks_b: np.ndarray, shared: int, pivots: int) -> np.ndarray:
    """The list in which each pair of rows counts (sorted ranks on either side); -1 if they share too few pivots."""
    same = (ranks_a[:, :, None] == ranks_b[:, None, :]).any(axis=2)
    first = same.argmax(axis=1)
    rest = same.copy()
    rest[np.arange(len(rest)), first] = False
    row = np.arange(len(same))
    name = ranks_a[row, first].astype(np.int64) * pivots + ranks_a[row, rest.argmax(axis=1)]
    return np.where(same.sum(axis=1) >= shared, name, -1)


def _links(group: dict, bounds: np.ndarray, threshold: float, shared: int, pivots: int):
    """Linked pairs (rows a, b) of the groups between ``bounds``, in parts. Groups are lists or pairs of blocks of them."""
    sizes = np.diff(bounds)
    small = np.flatnonzero((sizes > 1) & (sizes <= SMALL))
    many = np.cumsum(sizes[small] * (sizes[small] - 1) // 2)
    for part in np.split(small, np.searchsorted(many, np.arange(PAIRS, many[-1], PAIRS))) if len(small) else []:
        if len(part):
            rows = np.concatenate([np.arange(bounds[g], bounds[g + 1]) for g in part])
            a, b = (rows[x] for x in _spread(sizes[part]))
            yield _confirmed(group, a, b, threshold, shared, pivots)
    for g in np.flatnonzero(sizes > SMALL):
        rows = np.arange(bounds[g], bounds[g + 1])
        apart = group["low"][rows[0]] != group["high"][rows[0]]
        left, right = (rows[group["own"][rows] == group[side][rows[0]]] for side in ("low", "high"))
        v = unit(group["vec"][right])
        for some in np.array_split(left, max(1, -(-len(left) // 256))):
            near = unit(group["vec"][some]) @ v.T >= threshold
            a, b = np.nonzero(near if apart else near & (right[None, :] > some[:, None]))
            for part in np.array_split(np.arange(len(a)), max(1, -(-len(a) // PAIRS))):
                x, y = some[a[part]], right[b[part]]
                ok = _first_two(group["ranked"][x], group["ranked"][y], shared, pivots) == group["list"][x]
                yield x[ok], y[ok]


def _confirmed(group: dict, a: np.ndarray, b: np.ndarray, threshold: float, shared: int, pivots: int):
    ok = (group["own"][a] != group["own"][b]) | (group["low"][a] == group["high"][a])
    a, b = a[ok], b[ok]
    ok = _first_two(group["ranked"][a], group["ranked"][b], shared, pivots) == group["list"][a]
    a, b = a[ok], b[ok]
    ok = (unit(group["vec"][a]) * unit(group["vec"][b])).sum(axis=1) >= threshold if len(a) else np.zeros(0, bool)
    return a[ok], b[ok]


def _sums(group: dict, bounds: np.ndarray, threshold: float, shared: int, pivots: int) -> pa.RecordBatch:
    """(key, d1, other, n): by row with links, how many vectors it is linked with here, and the least of those that it
    reaches through links here."""
    size = len(group["key"])
    count, root = np.zeros(size, np.int64), np.arange(size)
    for a, b in _links(group, bounds, threshold, shared, pivots):
        np.add.at(count, a, group["n"][b])
        np.add.at(count, b, group["n"][a])
        while True:  # union-find on the rows of the task at hand
            a, b = root[a], root[b]
            far = a != b
            if not far.any():
                break
            np.minimum.at(root, np.maximum(a, b)[far], np.minimum(a, b)[far])
            while (root != root[root]).any():
                root = root[root]
    at = np.flatnonzero(count)
    columns = (group["key"][at], group["d1"][at], group["key"][root[at]], count[at])
    return pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["key", "d1", "other", "n"])


def _compare(threshold: float, shared: int, pivots: int):
    """Compares the rows of each group. Rows are sorted by group; of a batch's last group, rows wait for the next batch."""

    def groups(table: pa.Table):
        """The rows by dimension, with the bounds of the groups."""
        dims = table.column("dim").to_numpy()
        for part in np.split(np.arange(len(dims)), np.flatnonzero(np.diff(dims)) + 1):
            some = table.slice(part[0], len(part))
            group = {c: some.column(c).to_numpy() for c in ("key", "d1", "n", "list", "low", "high", "own", "start")}
            group |= {c: _matrix(some.column(c)) for c in ("vec", "ranked")}
            yield group, np.append(np.flatnonzero(group["start"]), len(part))

    def work(batches):
        wait, last = None, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids = list(zip(*(table.column(c).to_pylist() for c in ("label", "dim", "list", "low", "high")), strict=True))
            start = np.array([x != y for x, y in zip(ids, [last, *ids[:-1]], strict=True)])
            last = ids[-1] if ids else last
            table = table.append_column("start", pa.array(start))
            cut = np.flatnonzero(start)
            if not len(cut):
                wait = table if wait is None else pa.concat_tables([wait, table])
                continue
            done = table.slice(0, cut[-1]) if wait is None else pa.concat_tables([wait, table.slice(0, cut[-1])])
            wait = table.slice(cut[-1])
            if len(done):
                for group, bounds in groups(done):
                    yield _sums(group, bounds, threshold, shared, pivots)
        if wait is not None and len(wait):
            for group, bounds in groups(wait):
                yield _sums(group, bounds, threshold, shared, pivots)

    return work


def near_vectors(table: DataFrame, threshold: float = 0.93, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Per row of ``table`` (vec_id: bigint, embedding: array of numbers, label): vec_id, n_links, component_id, kept.

    Two vectors are linked if their labels are equal and not null and the cosine of their embeddings, in double precision,
    is at least ``threshold``; candidates are those that share ``shared`` of their ``nearest`` pivots. n_links counts
    other vec_ids linked directly, component_id is the smallest vec_id reachable. Embeddings that are null, empty or zero,
    or hold null or non-finite numbers, and embeddings of different lengths are linked with nothing. Equal vectors of a
    label are one until the end. Rows that repeat a vec_id give its result each; a null vec_id is linked with nothing,
    its own (null) component, and kept. An empty table gives an empty result. Other columns are not read.

    Lists longer than ``block`` are cut into blocks by hash, and every pair of blocks is a group of its own, so a task
    holds 2 * ``block`` rows whatever a list's length; links leave it as sums and as one edge a row.
    """
    rows = table.select("vec_id", "embedding", "label")
    good = usable(rows)
    vectors = stored(distinct_vectors(good), "vectors")
    index = inverted_lists(describe(vectors, fit(vectors, sample, pivots), pivots, nearest), pivots, nearest, shared)
    lists = index.select("label", "dim", "key", "d1", F.explode("lists").alias("list"))
    sizes = lists.groupBy("label", "dim", "list").agg(F.count("*").alias("size")).filter("size > 1")
    parts = F.ceil(F.col("size") / block).cast("int")
    dealt = lists.join(sizes, ["label", "dim", "list"]).select("label", "dim", "list", "key", "d1", parts.alias("parts"), F.pmod(F.xxhash64("key"), parts).cast("int").alias("own"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).drop("parts", "other")
    by = ["label", "dim", "list", "low", "high"]
    full = dealt.join(index.select("key", "d1", "n", "vec", "ranked"), ["key", "d1"]).select(*by, "own", "key", "d1", "n", "ranked", "vec")
    full = full.repartition(*by).sortWithinPartitions("dim", *by)
    found = stored(full.mapInArrow(_compare(threshold, shared, pivots), "key long, d1 long, other long, n long"), "links")
    sums = found.groupBy("key", "d1").agg(F.sum("n").alias("linked"))
    ids = good.select("vec_id", "label", "dim", "d1", "d2")
    classes = vectors.select("label", "dim", "d1", "d2", "key", "n").join(sums, ["key", "d1"], "left").fillna(0, "linked")
    # a vec_id of several vectors is linked with whatever any of them is linked with
    member = stored(ids.distinct().join(classes, ["label", "dim", "d1", "d2"]).select("vec_id", "key", (F.col("n") - 1 + F.col("linked")).alias("links")), "members")
    edges = found.select(F.col("key").alias("a"), F.col("other").alias("b")).unionByName(member.select(F.col("key").alias("a"), F.col("vec_id").alias("b")))
    group = components(edges).withColumnRenamed("node", "vec_id")
    links = member.groupBy("vec_id").agg(F.sum("links").alias("n_links")).join(group, "vec_id", "left")
    return (
        rows.select("vec_id").join(links, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )
