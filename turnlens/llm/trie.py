"""Conversation prefix trie (operator 13): families by base id first, then one merge of the families' nodes.

A family is the conversations of one base id. Its turns are cogrouped with the base's first turns, the conversations are
rebuilt, and a small trie is made in one task. Only the nodes of these tries, each once a family, meet in the shuffle that
merges them; what a node has below itself is summed up in the families again, each global node by one family.
"""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._shared import stored

#: Conversations of a family, and one more than the most turns that one takes from its base.
FAMILY, HEADS = 100, 6
ROOT = hashlib.md5(b"").digest()
NODES = "family long, at int, up int, node binary, parent binary, depth long, size long, n long, low long, ends string"


def turn_rows(turns: DataFrame) -> DataFrame:
    """(family, conv_id, turn, code, size): what stands for a turn from here on, its 128-bit digest and its length.

    The digest is of role and text with the role's length in front, so that no two pairs share it by shifting."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    code = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    family = F.col("conv_id") - F.col("conv_id") % FAMILY
    return turns.filter("conv_id is not null").select(family.alias("family"), "conv_id", "turn", code.alias("code"), F.length(text).cast("long").alias("size"))


def borrowed(conv_id: int) -> int:
    """How many turns of its base a conversation starts with."""
    return zlib.crc32(str(conv_id).encode()) % HEADS


def _in_order(table: pa.Table) -> list[tuple]:
    """(conv_id, code, size), by conversation, then turn (null first), then digest."""
    rows = zip(*(table.column(c).to_pylist() for c in ("conv_id", "turn", "code", "size")), strict=True)
    return [(c, code, size) for c, _, _, code, size in sorted((c, t is not None, t or 0, code, size) for c, t, code, size in rows)]


def _family_trie(key: tuple, turns: pa.Table, heads: pa.Table) -> pa.Table:
    """The trie of one family: nodes in the order of creation, so that parents come before children."""
    head = [(code, size) for _, code, size in _in_order(heads)]
    own: dict[int, list] = {}
    for c, code, size in _in_order(turns):
        own.setdefault(c, []).append((code, size))
    names = ("at", "up", "node", "parent", "depth", "size", "n", "low")
    place, table, ends = {ROOT: 0}, {c: [x] for c, x in zip(names, (0, None, ROOT, None, 0, 0, 0, None), strict=True)}, {}
    for c, rest in sorted(own.items()):
        h, at = borrowed(c), 0
        rebuilt = head[:h] + rest[h:]
        for depth in range(len(rebuilt) + 1):
            if depth:
                code, size = rebuilt[depth - 1]
                parent, node = table["node"][at], hashlib.md5(table["node"][at] + code).digest()
                if node not in place:
                    place[node] = len(place)
                    for name, x in zip(names, (place[node], at, node, parent, depth, size, 0, None), strict=True):
                        table[name].append(x)
                at = place[node]
            table["n"][at] += 1
            if table["low"][at] is None:
                table["low"][at] = c
        ends.setdefault(at, []).append(c)
    columns = {"family": [key[0].as_py()] * len(place)} | table | {"ends": [",".join(map(str, ends[k])) if k in ends else None for k in range(len(place))]}
    kinds = {"at": pa.int32(), "up": pa.int32(), "node": pa.binary(), "parent": pa.binary(), "ends": pa.string()}
    return pa.table({c: pa.array(x, kinds.get(c, pa.int64())) for c, x in columns.items()})


def family_nodes(turns: DataFrame) -> DataFrame:
    """The nodes (``NODES``) of the tries of all families; ``at`` and ``up`` are places in the family's trie."""
    rows = turn_rows(turns)
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "code")
    heads = rows.filter("conv_id = family").withColumn("k", F.row_number().over(order)).filter(F.col("k") < HEADS).drop("k")
    return rows.groupBy("family").cogroup(heads.groupBy("family")).applyInArrow(_family_trie, NODES)


def _below(key: tuple, nodes: pa.Table, owned: pa.Table) -> pa.Table:
    """Sums over subtrees of one family's trie, of the values of the nodes that the family owns."""
    values = {node: (leaves, saved) for node, leaves, saved in zip(*(owned.column(c).to_pylist() for c in ("node", "leaves", "saved")), strict=True)}
    rows = sorted(zip(*(nodes.column(c).to_pylist() for c in ("at", "up", "node")), strict=True))
    sums = [list(values.get(node, (0, 0))) for _, _, node in rows]
    for at, up, _ in reversed(rows):
        if up is not None:
            sums[up][0] += sums[at][0]
            sums[up][1] += sums[at][1]
    return pa.table({"node": pa.array([r[2] for r in rows], pa.binary()), "leaves": pa.array([x for x, _ in sums], pa.int64()), "saved": pa.array([x for _, x in sums], pa.int64())})


def _ends_digest(batches):
    """SHA-256 of the ids that end in each node, from rows (node, ends) sorted by node and family. The ids run through the
    digest row by row; none are gathered."""
    now, digest, out = None, None, []
    for batch in batches:
        for node, ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if node != now:
                if digest:
                    out.append((now, digest.hexdigest()))
                now, digest = node, hashlib.sha256()
                digest.update(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out])], names=["node", "ends_sha256"])
            out = []
    if digest:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=["node", "ends_sha256"])


def conversation_trie(turns: DataFrame) -> DataFrame:
    """Per node of the global trie of ``turns`` (conv_id, turn: bigint; role, text): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Every conversation c is rebuilt: the first crc32(c) % 6 turns of conversation c - c % 100, then its own turns after as
    many. A node is a distinct sequence of first rebuilt turns, known by a chain of 128-bit digests; conv_id is its
    smallest member. Turns are ordered by ``turn``, null first; turns of one number by the digest of role and text.
    Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out; repeated rows
    are turns of their own. An empty table gives no node. Other columns are not read.

    One task holds one family's turns, about 50 bytes each (no texts), and one family's trie.
    """
    families = stored(family_nodes(turns.select("conv_id", "turn", "role", "text")), "families")
    first = [F.any_value(c).alias(c) for c in ("parent", "depth", "size")]
    merged = stored(families.groupBy("node").agg(F.sum("n").alias("n_convs"), F.min("low").alias("conv_id"), *first), "nodes")
    kids = merged.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    merged = stored(merged.join(kids, "node", "left").fillna(0, "n_children"), "nodes")
    # each global node is summed up by one family that has it: that of its smallest member
    owner = (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family")
    owned = merged.select(owner, "node", (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    sums = families.select("family", "at", "up", "node").groupBy("family").cogroup(owned.groupBy("family")).applyInArrow(_below, "node binary, leaves long, saved long")
    sums = sums.groupBy("node").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = families.filter("ends is not null").select("node", "family", "ends").repartition("node").sortWithinPartitions("node", "family")
    ends = ends.select("node", "ends").mapInArrow(_ends_digest, "node binary, ends_sha256 string")
    parents = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        merged.join(sums, "node").join(ends, "node", "left").join(parents, "parent", "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
    )
