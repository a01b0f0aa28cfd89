"""Pivot index, Merkle manifest and prefix trie against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlens.llm import merkle, pivots, trie

from . import brute
from .test_corpus import clashing

VECTORS = "vec_id long, embedding array<float>, label int"


def links_brute(rows, threshold=0.93):
    """vec_id -> (n_links, component), comparing all pairs of a label."""
    ids, edges = {v for v, *_ in rows}, set()
    good = [(v, np.array(e, np.float32).astype(float), label) for v, e, label in rows if label is not None and e and None not in e and np.isfinite(e).all() and any(e)]
    for i, (a, x, la) in enumerate(good):
        for b, y, lb in good[:i]:
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                edges.add((min(a, b), max(a, b)))
    comp = brute.union_find(ids, edges)
    return {v: (sum(v in e for e in edges), comp[v]) for v in ids}


def families(draw, labels=3, dim=24):
    """Vectors in families at about 0.93 and above, families of copies, loners, chains."""
    rows, rng = [], np.random.default_rng(draw)
    for _ in range(40):
        base, noise = rng.normal(size=dim), rng.choice([0.0, 0.1, 0.25, 0.35])
        label = int(rng.integers(labels))
        rows += [(base + noise * rng.normal(size=dim), label) for _ in range(rng.integers(1, 9))]
    chain = rng.normal(size=dim)
    for _ in range(12):
        chain = chain + 0.25 * rng.normal(size=dim)
        rows.append((chain * rng.uniform(0.1, 9), 0))
    return [(k, [float(np.float32(x)) for x in v], label) for k, (v, label) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_near_vectors(spark, seed):
    rows = families(seed)
    want = links_brute(rows)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_vectors(clashing(spark.createDataFrame(rows, VECTORS)), pivots=64).collect()}
    found, all_ = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    print("recall of links:", found / all_)
    assert all(got[v][0] <= want[v][0] for v in want) and found >= 0.97 * all_


def test_exact_where_all_pivots_are_shared(spark):
    """With as many pivots as describe a vector every pair is a candidate: the result equals brute force, in blocks too."""
    rows = families(5, labels=2)
    hot = np.random.default_rng(6).normal(size=24)
    rng = np.random.default_rng(7)
    rows += [(1000 + k, [float(np.float32(x)) for x in hot + 0.15 * rng.normal(size=24)], 1) for k in range(150)]
    table = spark.createDataFrame(rows, VECTORS)
    want = links_brute(rows)
    for block in (16, 1024):
        got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in pivots.near_vectors(table, pivots=6, nearest=6, shared=4, block=block).collect()}
        assert got == want


def test_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = links_brute([tuple(r) for r in table.select("vec_id", "embedding", "label").collect()])
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_vectors(table).collect()}
    assert got == {v: (n, c, v == c) for v, (n, c) in want.items()}


def test_odd_vectors(spark):
    e, nan = [1.0, 2.0], float("nan")
    rows = [(1, e, 1), (1, e, 1), (2, e, 1), (3, e, None), (4, [1.0, 2.0, 0.0], 1), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [None, 1.0], 1), (None, e, 1), (10, [2.0, 4.0], 1), (11, [1e30, 2e30], 1), (12, e, 2)]
    table = clashing(spark.createDataFrame(rows, VECTORS))
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in pivots.near_vectors(table).collect())
    alone = [(str(v), 0, v, True) for v in (3, 4, 5, 6, 7, 8, 9, 12)]
    assert got == sorted([("1", 3, 1, True)] * 2 + [("2", 3, 1, False), ("10", 3, 1, False), ("11", 3, 1, False), ("None", 0, None, True), *alone])
    assert pivots.near_vectors(table.filter("false")).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def manifest_brute(rows):
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    h = lambda d, t, lang, source, n: sha("".join(map(field, (d, source, lang, n, t))))
    lower = lambda t: t and t.translate(brute._FOLD)
    out, groups = [], {}
    for d, t, lang, source, n in rows:
        hit = d is not None and zlib.crc32(str(d).encode()) % 3 == 0
        groups.setdefault(lang, []).append((d is not None, d or 0, h(d, t, lang, source, n), h(d, lower(t) if hit else t, lang, source, n), d))

    def tree(nodes):
        """Subroot and, for each node, its siblings (left, right) on the way up."""
        ways, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, way in enumerate(ways):
                run = at[k] // 8 * 8
                way.append((nodes[run : at[k]], nodes[at[k] + 1 : run + 8]))
                at[k] //= 8
            nodes = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
        return nodes[0], ways

    made = {}
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        leaves = sorted(groups[lang], key=lambda x: x[:3])
        made[lang] = (leaves, *tree([x[2] for x in leaves]))
    root, tops = tree([m[1] for m in made.values()])
    for (leaves, subroot, ways), top in zip(made.values(), tops, strict=True):
        for (_, _, leaf, changed, d), way in zip(leaves, ways, strict=True):
            x = changed
            for left, right in way + top:
                x = sha("".join(left) + x + "".join(right))
            out.append((d, leaf, subroot, root, sha("".join("".join(a + b) for a, b in way + top)), x, x == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("sizes", [[1], [8], [9], [1, 2], [700, 8, 1, 65], [600] * 2 + [3] * 70])
def test_manifest(spark, sizes):
    draw = random.Random(len(sizes))
    langs = [None, "é", "", "z", *[f"l{k}" for k in range(100)]]
    rows = [(draw.choice([None, draw.randrange(-5, 10**6)]) if draw.random() < 0.05 else draw.randrange(10**9), draw.choice(["Ab é", "", None, "xyz", "É A"]), langs[k], draw.choice([None, "s"]), draw.choice([None, 3])) for k, n in enumerate(sizes) for _ in range(n)]
    rows += rows[:20] if len(sizes) > 3 else []  # equal rows are leaves of their own
    table = clashing(spark.createDataFrame(rows, DOCS).repartition(5))
    got = sorted((tuple(r) for r in merkle.document_manifest(table).collect()), key=str)
    assert got == manifest_brute(rows)


def test_no_leaves(spark):
    assert merkle.document_manifest(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize(("n", "cuts"), [(1, []), (7, [3]), (8, [8]), (64, [1, 2, 30]), (100, [5, 9, 63, 64]), (585, [10, 500, 570])])
def test_ranges_cut_anywhere(n, cuts):
    """However leaves are dealt to runs, closed nodes and merged edges give the nodes of the whole tree, each once."""
    import pyarrow as pa

    leaves = [sha(str(k)) for k in range(n)]
    want, level, nodes = set(), 0, leaves
    while True:
        want |= {(level, k, d) for k, d in enumerate(nodes)}
        if len(nodes) == 1:
            break
        nodes, level = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)], level + 1
    got, edges = set(), {}
    for a, b in zip([0, *cuts], [*cuts, n], strict=True):
        batch = pa.record_batch({"g": pa.array([0] * (b - a), pa.int64()), "n": pa.array([n] * (b - a), pa.int64()), "i": pa.array(range(a, b), pa.int64()), "digest": pa.array(leaves[a:b], pa.string())})
        for part in merkle._ranges([batch] if b > a else []):
            for r in part.to_pylist():
                assert (r["level"], r["i"], r["digest"]) not in got
                got.add((r["level"], r["i"], r["digest"]))
                if r["open"]:
                    edges[r["level"], r["i"]] = r["digest"]
    for level in range(20):
        width = -(-n // 8**level)
        for up in sorted({i // 8 for (at, i) in edges if at == level and width > 1}):
            run = [edges[level, i] for i in range(8 * up, min(8 * up + 8, width))]
            edges[level + 1, up] = sha("".join(run))
            got.add((level + 1, up, edges[level + 1, up]))
    assert got == want


TURNS = "conv_id long, turn long, role string, text string"


def trie_brute(rows):
    code = lambda r, t: hashlib.md5(f"{len(r)}:{r}{t}".encode()).digest()
    convs = {}
    for c, k, r, t in rows:
        if c is not None:
            convs.setdefault(c, []).append((k is not None, k or 0, code(r or "", t or ""), (r or "", t or "")))
    own = {c: [x[-1] for x in sorted(v, key=lambda x: x[:3])] for c, v in convs.items()}
    base = lambda c: c - (abs(c) % 100) * (1 if c > 0 else -1)
    made = {c: tuple(own.get(base(c), [])[: zlib.crc32(str(c).encode()) % 6]) + tuple(v[zlib.crc32(str(c).encode()) % 6 :]) for c, v in own.items()}
    members = {}
    for c, path in made.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        ends = ",".join(map(str, sorted(c for c in cs if len(made[c]) == len(p))))
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), sum(q not in kids for q in below), saved, sha(ends)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_trie(spark, seed):
    draw = random.Random(seed)
    ids = [0, 1, 2, 3, 99, 100, 101, 205, 206, -1, -150, -100, 7000, *range(300, 360)]
    words = ["a", "b", "é😀", None, ""]
    rows = [(c, draw.choice([None, k, k, k, 2]), draw.choice(["u", "u", "v", None]), draw.choice(words[: draw.choice([1, 2, 5])])) for c in ids for k in range(draw.choice([1, 2, 4, 7, 9]))]
    rows += rows[:9] + [(None, 1, "u", "a"), (None, None, None, None)]
    rows += [(400 + k, t, "u", f"same {t}") for k in range(40) for t in range(5)]
    got = sorted((tuple(r) for r in trie.conversation_trie(clashing(spark.createDataFrame(rows, TURNS).repartition(3))).collect()), key=str)
    assert got == trie_brute(rows)


def test_no_turns(spark):
    none = spark.createDataFrame([], TURNS)
    assert trie.conversation_trie(none).count() == 0 and trie.conversation_trie(none.unionByName(spark.createDataFrame([(None, 1, "u", "x")], TURNS))).count() == 0


def test_long_turns(spark):
    """A very long text, and a conversation of many turns."""
    rows = [(1, 0, "u", "x" * 3_000_000), (101, 0, "u", "x" * 3_000_000), *[(5, k, "u", f"t{k}") for k in range(3000)]]
    nodes = trie.conversation_trie(spark.createDataFrame(rows, TURNS))
    got = nodes.agg(F.max("depth").alias("depth"), F.max("n_convs").alias("n")).first()
    assert got["n"] == 3 and 2990 <= got["depth"] <= 3000
