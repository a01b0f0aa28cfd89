"""Merkle dataset manifest (operator 12): a mountain range for each indexed run of leaves, then a merge of the edges.

Leaves are dealt by range and indexed within their group. A task folds a run of neighbouring leaves with a stack of
pending nodes: eight of them carry into their parent, as digits do in base 8. What a run cannot complete, because
neighbours lie in other tasks, are a few nodes a level; joins by parent complete them level by level.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import stored

FANOUT, BITS = 8, 3
#: Proofs are made for blocks of FANOUT ** LOCAL leaves in one task; above that, paths are joined.
LOCAL = 3
NODES = "g long, n long, level int, i long, digest string, open boolean"


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(values: list) -> F.Column:
    """SHA-256 (hex) of the values, each `-` if null, else its length in bytes, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def width(n, level):
    """How many nodes a group of n leaves has at a level."""
    return -(-n // FANOUT**level)


def height(n) -> F.Column:
    """The level at which one node of a group of n leaves remains (exact up to 2 ** 60 leaves)."""
    return sum((n > FANOUT**k).cast("int") for k in range(20))


def indexed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with g (the group, numbered so that g ascends as the group does, null first), n (rows of the group) and
    i (place in the group from 0, by ``order``, null first).

    Rows are dealt by range, so a group of any size is spread; only counts by part and group are summed up."""
    dealt = rows.withColumn("tie", F.monotonically_increasing_id())  # equal rows may be dealt to several parts
    by = [group, *order, "tie"]
    row = F.monotonically_increasing_id()
    dealt = stored(dealt.repartitionByRange(*by).sortWithinPartitions(*by).drop("tie").withColumn("row", row), "sorted")
    dealt = dealt.withColumn("part", F.shiftright("row", 33))
    counts = dealt.groupBy(group, "part").agg(F.count("*").alias("here"), F.min("row").alias("start"))
    before = W.partitionBy(group).orderBy("part")
    whole = before.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    shift = F.sum("here").over(before) - F.col("here") - F.col("start")
    counts = counts.select(F.col(group).alias("of"), F.col("part").alias("p"), shift.alias("shift"), F.sum("here").over(whole).alias("n"), F.min("start").over(whole).alias("g"))
    joined = dealt.join(counts, F.col(group).eqNullSafe(F.col("of")) & (F.col("part") == F.col("p")))
    return joined.withColumn("i", F.col("row") + F.col("shift")).drop("of", "p", "shift", "row", "part")


class Range:
    """The mountain range of one run of neighbouring leaves."""

    def __init__(self, g: int, n: int):
        self.g, self.n, self.pending, self.out = g, n, [], []

    def push(self, i: int, digest: str) -> None:
        """Adds the next leaf; full runs of eight, and the last run of a level, carry."""
        level = 0
        while True:
            if level == len(self.pending):
                self.pending.append([])
            nodes, wide = self.pending[level], width(self.n, level)
            nodes.append((i, digest))
            if wide == 1 or (i % FANOUT != FANOUT - 1 and i != wide - 1):
                return
            whole = len(nodes) == i % FANOUT + 1
            self._emit(level, not whole)
            if not whole:
                return  # the run's first nodes lie in another task
            i, digest, level = i // FANOUT, _hash("".join(d for _, d in nodes)), level + 1
            nodes.clear()

    def _emit(self, level: int, is_open: bool) -> None:
        self.out += [(self.g, self.n, level, i, d, is_open) for i, d in self.pending[level]]
        if is_open:
            self.pending[level].clear()

    def close(self) -> list[tuple]:
        """What is left at the end of the run: nodes without a complete parent, and the group's top."""
        for level in range(len(self.pending)):
            self._emit(level, width(self.n, level) > 1)
        return self.out


def _ranges(batches):
    """Node records of all runs in a task's rows (g, n, i, digest): a run ends where the next row is no neighbour."""
    now, last = None, None
    for batch in batches:
        done = []
        for g, n, i, digest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now.g != g or i != last + 1:
                done += now.close() if now else []
                now = Range(g, n)
            now.push(i, digest)
            last = i
        if now:
            done, now.out = done + now.out, []
        yield _records(done)
    if now:
        yield _records(now.close())


def _records(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 6
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["g", "n", "level", "i", "digest", "open"])


def tree(leaves: DataFrame) -> DataFrame:
    """(g, n, level, i, digest): all nodes of the trees of the groups of ``leaves`` (g, n, i, digest).

    Nodes that a run leaves open are joined by parent, eight at most, one level a round: about fifteen rows a run and
    level, whatever the number of leaves. The rounds go up to the height of the largest group."""
    made = stored(leaves.select("g", "n", "i", "digest").sortWithinPartitions("g", "i").mapInArrow(_ranges, NODES), "ranges")
    top = made.agg(F.max(height(F.col("n")))).first()[0] or 0
    nodes, merged = made.drop("open"), None
    for level in range(top):
        now = made.filter((F.col("level") == level) & F.col("open")).drop("open")
        now = now if merged is None else now.unionByName(merged.filter(F.col("n") > FANOUT**level))
        up = now.groupBy("g", "n", F.shiftright("i", BITS).alias("i")).agg(F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("d"))
        merged = stored(up.select("g", "n", F.lit(level + 1).alias("level"), "i", F.sha2(F.array_join("d.digest", "").cast("binary"), 256).alias("digest")), "merged")
        nodes = nodes.unionByName(merged)
    return nodes


def paths(nodes: DataFrame, lowest: int) -> DataFrame:
    """(g, i, level, digest, path): for the nodes at level ``lowest`` (the top, where a group is lower), the siblings
    left and right of each node on the way up, lowest first."""
    empty = F.array().cast("array<struct<left:string,right:string>>")
    now = nodes.filter(F.col("level") == height(F.col("n"))).withColumn("path", empty)
    top = nodes.agg(F.max("level")).first()[0] or 0
    for level in range(top - 1, lowest - 1, -1):
        runs = nodes.filter((F.col("level") == level) & (F.col("n") > FANOUT**level)).groupBy("g", "n", F.shiftright("i", BITS).alias("up"))
        runs = runs.agg(F.sort_array(F.collect_list(F.struct("i", "digest"))).alias("d"))
        parents = now.filter(F.col("level") == level + 1).select("g", F.col("i").alias("up"), "path")
        down = runs.join(parents, ["g", "up"]).select("g", "n", F.posexplode("d").alias("k", "x"), "d", "path")
        side = lambda a, size: F.array_join(F.slice("d.digest", a, size), "")
        pair = F.struct(side(F.lit(1), F.col("k")).alias("left"), side(F.col("k") + 2, F.lit(FANOUT)).alias("right"))
        down = down.select("g", "n", F.lit(level).alias("level"), "x.i", "x.digest", F.concat(F.array(pair), "path").alias("path"))
        now = stored(now.filter(F.col("level") <= level).unionByName(down), "paths")
    return now.select("g", "i", "level", "digest", "path")


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _proofs(batches):
    """Proofs of blocks of leaves. Rows (head, n, doc_id, leaf, changed, upper, subroot, root) are sorted by block, the
    head with the path above the block first, then by place."""
    head, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["head"]:
                if rows:
                    yield _block(head, rows)
                head, rows = row, []
            else:
                rows.append(row)
    if rows:
        yield _block(head, rows)


def _block(head: dict, rows: list[dict]) -> pa.RecordBatch:
    upper = [(x["left"], x["right"]) for x in head["upper"]]
    proof, local, nodes, level = "".join(a + b for a, b in upper), [], [r["leaf"] for r in rows], 0
    while level < LOCAL and width(head["n"], level) > 1:
        runs = [nodes[k : k + FANOUT] for k in range(0, len(nodes), FANOUT)]
        local.append([("".join(run[:k]), "".join(run[k + 1 :])) for run in runs for k in range(len(run))])
        nodes, level = [_hash("".join(run)) for run in runs], level + 1
    proofs, folded = [], []
    for k, row in enumerate(rows):
        own = [pairs[k // FANOUT**at] for at, pairs in enumerate(local)]
        proofs.append(_hash("".join(a + b for a, b in own) + proof))
        digest = row["changed"] or row["leaf"]
        for left, right in own + upper:
            digest = _hash(left + digest + right)
        folded.append(digest)
    n, root = len(rows), head["root"]
    columns = [[r["doc_id"] for r in rows], [r["leaf"] for r in rows], [head["subroot"]] * n, [root] * n, proofs, folded, [x == root for x in folded]]
    kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in RESULT.split(", ")])


def manifest(leaves: DataFrame) -> DataFrame:
    """``RESULT`` for every row of ``leaves`` (doc_id: bigint; lang: the group; leaf: hex; changed: hex or null).

    Leaves ascend by doc_id (null first; then by digest) within their group, groups by ``lang`` (null first, bytewise).
    Eight nodes, or the rest of a level, become the digest of their digests; what remains of each group is its subroot, and
    the subroots give the root in the same way. The proof of a leaf is its siblings, level by level from the leaf to the
    root; folded_root is made again from ``changed`` (else the leaf) and these siblings. Equal rows are leaves of their own.
    An empty table gives an empty result.
    """
    placed = stored(indexed(leaves.select("doc_id", "lang", "leaf", "changed"), "lang", ["doc_id", "leaf"]), "leaves")
    nodes = stored(tree(placed.withColumnRenamed("leaf", "digest")), "nodes")
    subroots = nodes.filter(F.col("level") == height(F.col("n"))).select(F.col("g").alias("group"), "digest")
    tops = stored(indexed(subroots.withColumn("one", F.lit(0)), "one", ["group"]), "subroots")
    roots = stored(tree(tops), "roots")
    root = roots.filter(F.col("level") == height(F.col("n"))).select("g", F.col("digest").alias("root"))
    above = tops.join(paths(roots, 0).select("i", F.col("path").alias("above")), "i").join(root, "g")
    above = above.select(F.col("group").alias("g"), F.col("digest").alias("subroot"), "above", "root")
    heads = paths(nodes, LOCAL).filter(F.col("level") <= LOCAL).select("g", F.col("i").alias("block"), "path").join(above, "g")
    sizes = placed.groupBy("g").agg(F.any_value("n").alias("n"))
    heads = heads.join(sizes, "g").select("g", "block", F.lit(True).alias("head"), "n", F.concat("path", "above").alias("upper"), "subroot", "root")
    rows = placed.select("g", F.shiftright("i", BITS * LOCAL).alias("block"), F.lit(False).alias("head"), "i", "doc_id", "leaf", "changed")
    rows = rows.unionByName(heads, allowMissingColumns=True).repartition("g", "block").sortWithinPartitions("g", "block", F.col("head").desc(), "i")
    return rows.select("head", "n", "doc_id", "leaf", "changed", "upper", "subroot", "root").mapInArrow(_proofs, RESULT)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, leaf, changed) of ``docs`` (doc_id, source, lang, n_chars, text). ``changed`` is the leaf after
    tampering, null where nothing is tampered with: a text's A-Z are lower-cased where 3 divides the CRC-32 of the
    decimal doc_id. Rows without a doc_id are not tampered with. Other columns are not read."""
    one = lambda text: leaf([F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), text])
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return stored(docs.select("doc_id", "lang", one(F.col("text")).alias("leaf"), F.when(hit, one(lower)).alias("changed")), "hashed")


def document_manifest(docs: DataFrame) -> DataFrame:
    """``manifest`` of documents: leaves by lang, doc_id, with a tampered part (see ``document_leaves``)."""
    return manifest(document_leaves(docs))
