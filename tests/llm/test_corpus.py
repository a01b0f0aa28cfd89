"""Corpus operators against brute force on small tables."""

import base64
import hashlib
import random
import time
from bisect import bisect_left

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnlens.llm import _stars, decontam, lines, mixing, neardup, pii, quality, substring, suffix, tokens, warc
from turnlens.llm._graph import components
from turnlens.llm._text import shingle_hashes, word_hashes, word_spans
from turnlens.llm.queries import VOCABULARY

from . import brute

ODD = [None, "", " ", "\n\n", "a", "A a", "x y z", "é", "日本語 テスト", "a" * 3000, "😀 " * 40, "\t \x0b\x0c\r"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(draw, n, vocabulary=400):
    return " ".join(f"w{draw.randrange(vocabulary)}" + draw.choice(["", ".", ","]) for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    draw = random.Random(3)
    texts = list(ODD)
    base = [words(draw, draw.randrange(30, 200)) for _ in range(40)]
    shared = words(draw, 60)
    for b in base:
        texts.append(b)
        if draw.random() < 0.6:
            w = b.split()
            for _ in range(draw.randrange(1, 6)):
                w[draw.randrange(len(w))] = f"e{draw.randrange(99)}"
            texts.append(" ".join(w).upper() if draw.random() < 0.3 else " ".join(w))
        if draw.random() < 0.3:
            texts += [b, b]
        if draw.random() < 0.4:
            texts.append(f"{words(draw, 20)}\n{shared} {words(draw, 10)}")
    texts += ["one line here that is said often\n" + words(draw, 40) for _ in range(5)]
    draw.shuffle(texts)
    return [(k, t, draw.choice(["en", "fr", None]), draw.choice(["a", "a", "a", "b", None]), len(t or "")) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(docs):
    """Extra columns whose names the operators use inside."""
    names = ("__s", "__b", "__h", "__n", "__p", "__band", "__removed", "removed", "t", "doc", "s", "row", "k", "first", "at", "size", "d1", "known", "key", "h", "c", "n", "a", "b", "kept", "bucket", "component", "spans", "block", "slot", "position", "_s", "text_", "n_words", "reason")
    return docs.withColumns({x: F.lit("x") for x in names})


def test_components(spark):
    draw = random.Random(1)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(200)] + [(500, 500 + k) for k in range(200)] + [(k, k + 1) for k in range(700, 760)]
    nodes = {x for e in edges for x in e}
    want = brute.union_find(nodes, edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in want.items() if x in got} and all(want[x] == x for x in nodes - set(got))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(docs, corpus, empty):
    rows = {r["doc_id"]: r for r in quality.quality_rules(clashing(docs), VOCABULARY).collect()}
    assert len(rows) == len(corpus)
    for d, t, *_ in corpus:
        r = rows[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute.base_rules(t)
        assert not r["base_failed"] or not r["kept"]
    assert quality.quality_rules(empty, VOCABULARY).count() == 0


def test_fertility(docs, corpus, spark):
    """Characters per token, byte-fallback share, entropy and the verdict, from the tokens themselves."""
    import math
    from collections import Counter

    enc = quality.encoder(VOCABULARY)
    made = [("raw bytes " * 2 + "".join(chr(0x1F300 + k % 700) for k in range(300)) + " word" * 60, "en"), ("the " * 400, "en"), ("#$ %& word " * 60, "en"), ("ok", None)]
    table = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(9000 + k, t, lang) for k, (t, lang) in enumerate(made)], "doc_id long, text string, lang string"))
    texts = {d: (t, lang) for d, t, lang, *_ in corpus} | {9000 + k: x for k, x in enumerate(made)}
    reasons = set()
    for r in quality.quality_rules(table, VOCABULARY).collect():
        t, lang = texts[r["doc_id"]]
        ids = enc.encode_ordinary(t or "")
        whole = [enc.decode_single_token_bytes(i) for i in ids]
        share = sum(b.decode(errors="replace").encode() != b for b in whole) / max(len(ids), 1)
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in Counter(ids).values())
        assert (r["n_tokens"], r["chars_per_token"]) == (len(ids), pytest.approx(len(t or "") / max(len(ids), 1)))
        assert r["byte_fallback_share"] == pytest.approx(share) and r["token_entropy"] == pytest.approx(entropy, abs=1e-9)
        low, high, most, least = quality.BANDS.get(lang, quality.BANDS[r["script"]])
        bad = not low <= r["chars_per_token"] <= high or share > most or entropy < least * math.log2(min(max(len(ids), 2), 2048))
        assert r["fertility_failed"] == bad and r["kept"] == (not bad and not r["base_failed"])
        reasons.add(r["reason"])
    assert {"few_words", "repeats", "byte_fallback"} <= reasons or {"few_words", "repeats", "chars_per_token_low"} <= reasons


def odd_tables(spark):
    """Rows with nulls in every column, repeated rows, one id with two texts, and no rows at all."""
    long = "some words that are long enough to be found again in another text of this table, whatever comes before or after. " * 2
    rows = [(1, long, "en", "a", 1), (1, long, "en", "a", 1), (2, "x " + long, None, None, None), (2, "other " + long + "end", "fr", "b", 2), (None, long, None, None, None), (None, None, None, None, None), (3, None, "en", "a", 0), (4, "", "de", "a", 0)]
    table = clashing(spark.createDataFrame(rows, SCHEMA))
    return rows, table, table.filter("false")


def test_odd_input(spark):
    """Every operator gives a result for every row, null ids lose nothing, and columns that are there already stay."""
    rows, table, none = odd_tables(spark)
    bench = spark.createDataFrame([(1, rows[0][1]), (None, "q"), (2, None), (1, rows[0][1])], "item_id long, text string")
    for t, n in ((table, len(rows)), (none, 0)):
        assert mixing.mix(t, block_rows=2).count() == n and quality.quality_rules(t, VOCABULARY).count() == n
        assert pii.find_pii(t).count() == n and lines.line_report(t).count() == n and neardup.near_duplicates(t).count() == n
        assert suffix.substring_dedup(t).count() == n and lines.remove_lines(t).columns == t.columns
        found = decontam.contaminated(t, bench).collect()
        assert {r["doc_id"] for r in found} == ({1, 2, None} if n else set())
        assert (tokens.token_counts(t, VOCABULARY).count() > 0) == (n > 0)
    near = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(table).collect() if r["doc_id"] is not None)
    assert near == [(1, 1, True), (1, 1, True), (2, 1, False), (2, 1, False), (3, 3, True), (4, 4, True)]
    cut = {(r["doc_id"], r["n_bytes"]): r["n_removed"] for r in suffix.substring_dedup(table).collect()}
    size = len(rows[0][1])
    assert cut[1, size] == 0 and cut[None, size] == 0 and cut[2, size + 2] == cut[2, size + 9] == size + 1 and cut[3, 0] == cut[4, 0] == 0
    spans = {(r["doc_id"], r["n_removed"]) for r in substring.repeated_passages(table).collect()}
    assert {d for d, _ in spans} == {2} and len(spans) <= 2
    kept = {(r["doc_id"], r["text"]) for r in substring.remove_passages(table).collect()}
    assert (1, rows[0][1]) in kept and (None, rows[0][1]) in kept and (None, None) in kept
    stay = [(r["doc_id"], r["text"]) for r in lines.remove_lines(table).collect()]
    assert sorted(t is None for _, t in stay) == sorted(r[1] is None for r in rows) and (None, rows[0][1]) in stay
    assert len(lines.remove_lines(table, least_words=50).collect()) <= len(rows)


def test_odd_pages(spark):
    rows = [(1, "u", "<a>"), (1, "u", "<a>"), (2, None, "<a>"), (None, "v", "<a>"), (None, None, None), (3, "w", None)]
    table = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.archive_round_trip(table).collect())
    assert got == [("1", 3, "response", None), ("1", 3, "response", None), ("2", 3, "revisit", 1), ("3", 0, "response", None), ("None", 0, "response", None), ("None", 3, "response", None)]


def test_line_recall(spark):
    """Of pairs of lines at similarity 0.8 or little more, of all lengths, nearly all share a bucket and pass the sketch."""
    draw = random.Random(6)
    rows, pairs = [], []
    while len(pairs) < 400:
        n = draw.choice([12, 25, 40, 80, 200, 600])
        line = "".join(draw.choice("abcdefghij klmnop") for _ in range(n))
        other = list(line)
        for _ in range(max(1, n // 60)):
            other[draw.randrange(n)] = draw.choice("xyz")
        a, b = dense(line), dense("".join(other))
        if 0.8 <= len(a & b) / len(a | b) < 0.86:
            pairs.append((len(rows), len(rows) + 1))
            rows += [(len(rows), line), (len(rows) + 1, "".join(other))]
    table = spark.createDataFrame(rows, "h long, line string")
    buckets, about = {}, {r["key"]: r["about"] for r in lines.sketches(table).collect()}
    for r in lines.band_rows(table).collect():
        buckets.setdefault(r["key"], set()).add(r["bucket"])
    apart = lambda a, b: (a["a"] ^ b["a"]).bit_count() + (a["b"] ^ b["b"]).bit_count()
    met = [bool(buckets[a] & buckets[b]) and apart(about[a], about[b]) <= lines.FAR for a, b in pairs]
    print("recall of lines at 0.80 to 0.86:", sum(met) / len(met))
    assert sum(met) >= 0.97 * len(met)


def test_quality_bands(spark):
    draw = random.Random(2)
    good = " ".join(draw.choice("the of and people water house little river they were walking under morning light because something".split()) + draw.choice(["", ","]) for _ in range(80))
    junk = " ".join("".join(chr(draw.randrange(0x1F300, 0x1F5FF)) for _ in range(3)) for _ in range(80))
    df = spark.createDataFrame([(1, good, "en"), (2, junk, "en"), (3, junk, None)], "doc_id long, text string, lang string")
    rows = {r["doc_id"]: r for r in quality.quality_rules(df, VOCABULARY).collect()}
    assert rows[1]["kept"] and not rows[2]["kept"] and rows[2]["byte_fallback_share"] > 0.5 and rows[3]["script"] == "other"


@pytest.mark.parametrize("text", ["", "a  b", "x" + " " * 9000 + "y", " " * 9000 + "\ny", "a\n" + "\n" * 5000, "é" * 50, "日本" * 30 + " 😀"])
def test_encode_whole_text(text):
    """The ids decode to the text, and cutting out white space changes nothing."""
    ids = quality.encode(VOCABULARY, text)
    enc = quality.encoder(VOCABULARY)
    assert b"".join(enc.decode_single_token_bytes(i) for i in ids.tolist()) == text.encode()
    assert ids.tolist() == enc.encode_ordinary(text)


@pytest.mark.parametrize("rule", tokens.RULES)
def test_token_counts(docs, corpus, rule):
    rows = {}
    for r in tokens.token_counts(docs, VOCABULARY, rule=rule).collect():
        rows.setdefault(r["doc_id"], []).append(r)
    enc = quality.encoder(VOCABULARY)
    for d, t, *_ in corpus:
        t = t or ""
        got = sorted(rows[d], key=lambda r: r["section"])
        parts = t.splitlines(keepends=True) if not set(t) & set("\r\x0b\x0c\x1c\x85 ") else None
        if parts is not None:
            assert [t[r["start_char"] : r["end_char"]] for r in got] == (parts or [""])
        ids = enc.encode_ordinary(t)
        assert sum(r["n_tokens"] for r in got) == pytest.approx(len(ids))
        if rule != "first":
            section = [max(s for s, r in enumerate(got) if r["start_char"] <= k) for k in range(len(t))]
            firsts, n = [], 0  # the byte at which each character starts
            for c in t:
                firsts.append(n)
                n += len(c.encode())
            want, at = [0.0] * len(got), 0
            for i in ids:
                size = len(enc.decode_single_token_bytes(i))
                own = [section[k] for k in range(bisect_left(firsts, at), bisect_left(firsts, at + size))]
                own = own or [section[max(bisect_left(firsts, at) - 1, 0)]]
                at += size
                if rule == "last":
                    want[own[-1]] += 1
                elif rule == "most":
                    want[max(sorted(set(own)), key=own.count)] += 1
                else:
                    for x in own:
                        want[x] += 1 / len(own)
            assert [r["n_tokens"] for r in got] == pytest.approx(want)
            continue
        want, at = [0] * len(got), 0
        for i in ids:  # the section of the character that the token's first new character is
            raw = enc.decode_single_token_bytes(i)
            before = len(t.encode()[:at].decode(errors="ignore"))
            head = raw[0] & 0xC0 != 0x80 or any(b & 0xC0 != 0x80 for b in raw)
            place = before if head and (raw[0] & 0xC0) != 0x80 else before + (0 if not head else 1)
            place = max(0, place - (not head) * 0)
            k = max(s for s, r in enumerate(got) if r["start_char"] <= min(place, max(len(t) - 1, 0)))
            want[k] += 1
            at += len(raw)
        assert [r["n_tokens"] for r in got] == want


def test_near_duplicates(docs, corpus, empty):
    for size, threshold in ((3, 85), (5, 80)):
        want = brute.near_components([(d, t) for d, t, *_ in corpus], size, threshold)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(clashing(docs), size, threshold).collect()}
        assert got == want and any(c != d for d, (_, c) in want.items())
    assert neardup.near_duplicates(empty).count() == 0
    odd = docs.filter("doc_id < 20").unionByName(docs.filter("doc_id < 20")).withColumn("doc_id", F.when(F.col("doc_id") > 2, F.col("doc_id")))
    assert neardup.near_duplicates(odd).count() == odd.count()


def test_couples_in_a_large_family(spark):
    draw = random.Random(4)
    base, rows = [f"w{k}" for k in range(200)], []
    for k in range(150):
        places = draw.sample(range(200), 6)
        for m in (0, 1):
            text = list(base)
            for place in places[:2]:
                text[place] = f"x{k}"
            for place in places[2 + 2 * m : 4 + 2 * m]:
                text[place] = f"y{k}_{m}"
            rows.append((2 * k + m, " ".join(text)))
    want = {d: c for d, (_, c) in brute.near_components(rows, 3, 85).items()}
    # alike enough to share buckets, but each linked to the other of its couple only
    assert len(set(want.values())) > 100
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def versions(n, lines_only=False):
    """2 * n near copies of a text A and n of a version B of it, the versions about 0.7 alike."""
    draw, unit = random.Random(12), "abcdefghijklmnopqrstuvwxyz"
    base = [draw.choice(unit) for _ in range(300)] if lines_only else [f"w{k}" for k in range(200)]
    other = list(base)
    for place in range(10, len(base), len(base) // (9 if lines_only else 12)):
        other[place] = "#" if lines_only else f"v{place}"
    rows = []
    for k in range(3 * n):
        text = list(base if k % 3 else other)
        for place in draw.sample(range(len(text)), 2):
            text[place] = draw.choice(unit.upper()) if lines_only else f"x{k}_{place}"
        rows.append((k, ("" if lines_only else " ").join(text)))
    return rows


@pytest.fixture
def pairs(monkeypatch):
    """The pairs that are compared, counted."""
    counts, plain = [], _stars.compared

    def counted(pools, *args):
        counts.append(pools.count())
        return plain(pools, *args)

    monkeypatch.setattr(_stars, "compared", counted)
    return counts


@pytest.mark.parametrize("fuzzy_lines", [False, True])
def test_pairs_grow_with_the_members_of_a_version(spark, pairs, fuzzy_lines):
    made = {}
    for n in (50, 100, 200):
        pairs.clear()
        rows = versions(n, fuzzy_lines)
        table = spark.createDataFrame(rows, "doc_id long, text string")
        if fuzzy_lines:
            left = set(range(3 * n)) - {r["doc_id"] for r in lines.repeated_lines(table).collect()}
        else:
            left = {r["doc_id"] for r in neardup.near_duplicates(table, 3, 85).filter("kept").collect()}
        made[n] = sum(pairs)
        if n <= 50:
            want = {d for d, t in rows} - {d for d, _ in line_brute(rows)} if fuzzy_lines else {d for d, (_, c) in brute.near_components(rows, 3, 85).items() if c == d}
            assert left == want
        assert len(left) < 0.1 * n + 2
    print("pairs compared:", made)
    # linear: under twelve pairs a member (all pairs of the second version alone would be 19,900 at 200)
    assert all(made[n] < 12 * 3 * n for n in made)


def test_pairs_of_a_spread_family(spark, pairs):
    """Copies of a text with few to many edits each: half of them are linked with nothing, few pairs are compared."""
    draw = random.Random(17)
    base, words = [f"w{k}" for k in range(150)], [f"x{k}" for k in range(20)]
    rows = []
    for k in range(400):
        text = list(base)
        for place in draw.sample(range(150), 1 + k % 12):
            text[place] = draw.choice(words)
        rows.append((k, " ".join(text)))
    want = {d: c for d, (_, c) in brute.near_components(rows, 3, 85).items()}
    assert 100 < len(set(want.values())) < 300
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    print("pairs compared:", sum(pairs))
    assert sum(pairs) < 30 * len(rows)


def test_pairs_of_lines_that_lack_the_same(spark, pairs):
    """Lines that all lack the same piece of their centre, and are otherwise edited apart: none is linked, few pairs are
    compared, and those that are linked (every tenth with its successor) are found."""
    draw = random.Random(23)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = "".join(draw.choice(letters) for _ in range(400))
    rows = [(k, base[:k] + "#" + base[k + 1 :]) for k in range(60)]
    for k in range(240):
        line = list(base[:180] + base[230:])
        for place in draw.sample(range(len(line)), 4):
            line[place] = draw.choice(letters.upper())
        rows.append((len(rows), "".join(line)))
        if k % 10 == 0:
            rows.append((len(rows), "".join(line[:-1])))
    want = {d for d, _ in line_brute(rows)}
    got = {r["doc_id"] for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    print("pairs compared:", sum(pairs), "of", len(rows), "lines, of which go", len(want))
    assert got == want
    assert sum(pairs) < 9 * len(rows)


def test_a_spread_family_takes_few_pairs(spark, pairs):
    """Differences that are shared by few come first, so under ten pairs a member are compared."""
    test_pairs_of_a_spread_family(spark, pairs)
    assert sum(pairs) < 10 * 400


def test_recall_of_lines_end_to_end(spark):
    """Families of lines, with shared beginnings, versions, chains and couples: components against brute force."""
    draw, rows = random.Random(31), []
    letters = "abcdefghijklmnopqrstuvwxyz     "
    head = "".join(draw.choice(letters) for _ in range(40))
    for family in range(60):
        base = head * (family % 3 == 0) + "".join(draw.choice(letters) for _ in range(draw.choice([20, 40, 60, 120])))
        for _ in range(draw.choice([2, 4, 12])):
            line = list(base)
            for _ in range(draw.choice([0, 1, 1, 2, 3])):
                line[draw.randrange(len(line))] = draw.choice("XYZ")
            rows.append((len(rows), "".join(line)))
    want = {d for d, _ in line_brute(rows)}
    got = {r["doc_id"] for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    recall = len(got & want) / len(want)
    print("recall of lines, end to end:", recall)
    assert recall >= 0.99 and got <= want


def test_optimal_densification():
    for n in (1, 2, 5, 100, 5000):
        sig = neardup.signature(np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)))
        assert len(sig) == neardup.BINS and len(neardup.band_keys(sig)) == neardup.BANDS


PII = [
    "mail a.b+c@x-y.example.com, a@b@c.de or a@b.c_d@e.fr; @no no@ x@y", "1.2.3.4.5.6.7.8.9 999.1.1.1 10.0.0.255 01.002.3.4 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112 and 4111  1111 1111 1111; 0000000000000", "call +49 (30) 123-456.78- or +1 or ++33 1 23 45 67 89 or +1234567890123456",
    "see https://user@host.example.com/path?q=1, ftp://x mailto:me@site.org; tel:+4930123456", "account no: 12345678 IBAN DE89370400440532013000, token = \"24be64439e3e\" token = word",
    "é@é.com ü1.1.1.1ü 😀a@b.cc", "1 2 3 4 5 6 7 8 9 0 1 2 3 4", "", None, "9" * 5000, "@" * 500, "+1" * 300, "a" * 3000 + "@b.c",
]


def test_personal_data(spark, docs, corpus):
    table = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string").unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    texts = dict(enumerate(PII)) | {d + 1000: t for d, t, *_ in corpus}
    rows = {r["doc_id"]: r for r in pii.find_pii(table).collect()}
    for d, t in texts.items():
        want = brute.base_spans(t)
        assert rows[d]["base_spans"] == brute.span_string(want)
        assert [rows[d][f"n_{k}"] for k in want] == [len(x) for x in want.values()]
    assert rows[4]["n_address"] == 3 and rows[5]["n_account"] == 3
    draw = random.Random(4)
    for _ in range(300):
        t = "".join(draw.choice("a1 0@.+-(4é\n") for _ in range(60))
        assert {k: v for k, v in pii.find_spans(t).items() if k in pii.BASE_KINDS} == brute.base_spans(t)
    for t in ("9" * 1_000_000, "1." * 300_000, "http://-" * 50_000, "mailto:-" * 50_000, "tel:" * 100_000, "a@" * 300_000):
        began = time.perf_counter()
        pii.find_spans(t)
        assert time.perf_counter() - began < 20  # linear: about a second
    again = clashing(docs.unionByName(docs))
    assert pii.find_pii(again).count() == 2 * len(corpus) and pii.find_pii(docs.filter("false")).count() == 0
    assert all(r["n_spans"] == sum(r[f"n_{k}"] for k in pii.KINDS) for r in rows.values())
    assert pii.redact("x a@b.cc y", pii.find_spans("x a@b.cc y")) == "x [email] y"


def line_brute(rows, threshold=80):
    found = {}
    for d, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if brute.WORD.search(line):
                found[d, k] = line
    sets = {line: dense(line) for line in set(found.values())}
    distinct = list(sets)
    edges = [
        (a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])
    ]
    comp = brute.union_find(distinct, edges)
    first = {}
    for place in sorted(found):
        first.setdefault(comp[found[place]], place)
    return {place for place, line in found.items() if first[comp[line]] != place}


def test_lines(docs, corpus, empty):
    want = line_brute([(d, t) for d, t, *_ in corpus])
    got = {(r["doc_id"], r["line_no"]) for r in lines.repeated_lines(clashing(docs)).collect()}
    assert got == want and want
    texts = {d: t for d, t, *_ in corpus}
    for r in lines.remove_lines(docs).collect():
        kept = [x for k, x in enumerate((texts[r["doc_id"]] or "").split("\n")) if (r["doc_id"], k) not in want]
        assert (r["text"] or "") == "\n".join(kept)
    assert lines.line_report(empty).count() == 0 and lines.line_report(docs).count() == len(corpus)


def dense(line):
    return {line[k : k + 5] for k in range(max(1, len(line) - 4))}


def test_lines_are_covered_by_shingles(spark):
    same = "数据处理系统可以把每一行文本都读进来然后和别的行比较最后只留下其中的一行文本不会丢掉任何一个字符"
    texts = ["ABCDEFGHIJKL0001", "ABCDEFGHIJKL0002", "2024-01-01T00:00", "2024-01-01T09:59", "4111111111111111", "4111111111112222", same, "新" + same]
    texts += ["ab", "a\r", "a", "😀😀x", "one word of this line is not like the other one, which is all that differs between them here", "one word of this line is not like the other two, which is all that differs between them here"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    texts.append("".join(chr(0x4E00 + k) for k in range(200)))
    hashed = {x: h for t in texts for x, h in zip(dense(t), spark.createDataFrame([(x,) for x in dense(t)], "x string").select(F.xxhash64(F.encode("x", "UTF-32"))).toPandas().iloc[:, 0], strict=True)}
    got = {r["text"]: set(r["s"]) for r in spark.createDataFrame([(t,) for t in texts], "text string").select("text", lines.shingle_hashes(F.col("text")).alias("s")).collect()}
    assert got == {t: {hashed[x] for x in dense(t)} for t in texts}
    # 11 of 13 shingles alike (1), one more at the head (7), one word edited (13); the other codes share too few
    near = {b for b, t in enumerate(texts) if any(100 * len(dense(t) & dense(u)) >= 80 * len(dense(t) | dense(u)) for u in texts[:b])}
    assert {r["doc_id"] for r in lines.repeated_lines(rows).collect()} == near == {1, 7, 13}


def test_lines_of_a_chain_stay_together(spark):
    draw = random.Random(8)
    text = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1300))
    # each line is like the next three or so (82 of 90 shingles alike), and no two far ones are
    rows = spark.createDataFrame([(k, text[4 * k : 4 * k + 90]) for k in range(300)], "doc_id long, text string")
    assert {r["doc_id"] for r in lines.repeated_lines(rows).collect()} == set(range(1, 300))


def test_decontamination(spark, docs, corpus, empty):
    draw = random.Random(9)
    items = [words(draw, n, 3000) for n in (15, 22, 30, 41, 60)] + ["too short", None]
    edited = items[3].split()
    edited[20] = "changed"
    planted = [
        (5000, words(draw, 80, 3000) + " " + items[1] + " " + words(draw, 50, 3000)), (5001, items[0].upper()), (5002, words(draw, 30, 3000) + "\n" + " ".join(edited)),
        (5003, words(draw, 300, 3000)), (5004, " ".join(items[4].split()[:15]) + " " + words(draw, 90, 3000)), (5005, None), (5006, ""),
    ]
    table = spark.createDataFrame(planted, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in decontam.contaminated(table, bench).collect()}

    def best(text, item):  # unit weights: no two items share a shingle
        from collections import Counter

        grams = lambda t: [tuple(w[i : i + 5]) for w in [brute.WORD.findall(t.lower())] for i in range(len(w) - 4)]
        a, b = grams(text or ""), grams(item or "")
        if not a or not b:
            return 0
        top, m = 0, min(len(a), len(b))
        for s in range(len(a) - m + 1):
            x, y = Counter(a[s : s + m]), Counter(b)
            top = max(top, sum((x & y).values()) / sum((x | y).values()))
        return top

    want = {(d, k): s for d, t in [*planted, *((d, t) for d, t, *_ in corpus)] for k, item in enumerate(items) if (s := best(t, item)) >= 0.8}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and {d for d, _ in got} >= {5000, 5001}
    assert decontam.contaminated(empty, bench).count() == 0 and decontam.contaminated(docs, bench.filter("false")).count() == 0
    blocks = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(table, bench, block_items=2).collect()}
    assert blocks == set(want)


def test_decontamination_of_shared_phrases(spark):
    """Exact weights against brute force, on items that share phrases, and copies of items."""
    from collections import Counter
    from fractions import Fraction

    draw = random.Random(4)
    phrases = [words(draw, n, 300) for n in (6, 9, 14)]
    items = [(k, f"{words(draw, draw.randint(4, 18), 300)} {draw.choice(phrases)} {words(draw, 3, 300)}") for k in range(24)]
    items += [(30, items[0][1].upper()), (31, items[5][1]), (31, items[5][1].upper()), (32, phrases[2])]
    docs = []
    for d in range(30):
        parts = []
        for _ in range(6):
            some = draw.choice(items)[1].split()
            if draw.random() < 0.6:
                some[draw.randrange(len(some))] = "changed"
            parts += [" ".join(some), words(draw, 12, 300)]
        docs.append((d, "\n".join(parts)))
    docs += [(40, phrases[1]), (41, " ".join(phrases * 30))]
    grams = lambda t: [tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(len(w) - 4)]
    bags = {k: Counter(grams(t)) for k, t in items}
    df = Counter(g for bag in bags.values() for g in bag)
    weigh = lambda bag: sum(n * Fraction(1, df.get(g, 1)) for g, n in bag.items())
    want = {}
    for d, text in docs:
        own = grams(text)
        for k, bag in bags.items():
            wide = min(len(own), bag.total())
            tops = [(weigh(w & bag) / weigh(w | bag), -s) for s in range(len(own) - wide + 1) for w in [Counter(own[s : s + wide])]]
            if tops and max(tops)[0] >= Fraction(4, 5):
                want[d, k] = (float(max(tops)[0]), -max(tops)[1])
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]): (r["similarity"], r["start_word"]) for r in found}
    assert len(found) == len(got) and got.keys() == want.keys() and len(want) > 60
    assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in want)


def test_decontamination_memory_is_level():
    """A text full of a phrase that all items share costs the same with 500 and with 20,000 items."""
    import tracemalloc

    phrase = " ".join(f"p{k}" for k in range(12))
    text = " ".join([f"{phrase} x{k} y{k}" for k in range(250)])
    peaks = []
    for count in (500, 20_000):
        bench = decontam.Benchmark([(k, (" ".join(f"a{k}_{j}" for j in range(20)) + " " + phrase).encode()) for k in range(count)], 5, 22, 0.8)
        buf = np.frombuffer(text.encode(), np.uint8)
        shingles = shingle_hashes(word_hashes(buf, *word_spans(buf, np.array([0, len(buf)])), fold_case=True), 5)
        hits = np.flatnonzero(np.isin(shingles, bench.shingles))
        assert len(hits) == 250 * 8
        tracemalloc.start()
        assert bench.matches(shingles, hits) == {}
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0] + 1e5


PAGES = [(5, "http://e.org/a b", "<p>same</p>"), (2, "u", "<p>same</p>"), (9, None, None), (3, "v", ""), (7, "w", "é\r\n\r\nWARC/1.0\r\n" * 50), (8, "w", "x" * 200_000), (4, "http://e.org", "<p>same</p>")]


def test_warc(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    rows = {r["page_id"]: tuple(r)[1:] for r in warc.archive_round_trip(pages).collect()}
    first = {}
    for p, _, html in sorted(PAGES):
        first.setdefault(html or "", p)
    for p, _, html in PAGES:
        raw, f = (html or "").encode(), first[html or ""]
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert rows[p] == (len(raw), digest, "revisit" if f < p else "response", f if f < p else None)
    assert warc.archive_round_trip(pages.filter("false")).count() == 0


def test_warc_members(spark, tmp_path):
    import gzip
    import json

    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1)
    warc.write_monolithic(warc.warc_records(pages), str(tmp_path / "whole"))
    index = warc.normalise(spark, str(tmp_path / "whole"), str(tmp_path / "members"))
    whole = b"".join(gzip.open(p).read() for p in sorted((tmp_path / "whole").glob("*.gz")))
    made = sorted((tmp_path / "members").glob("*.warc.gz"))
    assert b"".join(gzip.open(p).read() for p in made) == whole
    for r in index.collect():
        with open(r["archive"].removeprefix("file:"), "rb") as f:
            f.seek(r["offset"])
            record = gzip.decompress(f.read(r["length"]))
        assert record.startswith(b"WARC/1.0\r\n") and record.endswith(b"\r\n\r\n") and r["record_id"].encode() in record
        assert warc.read_member(r["archive"], r["offset"], r["length"])[0]["warc-record-id"] == r["record_id"]
    sidecar = [json.loads(x) for p in made for x in open(f"{p}.idx")]
    assert len(sidecar) == len(PAGES)
    # archives of many members and a broken one
    again = list(warc.read_records(open(made[0], "rb")))
    assert len(again) == sum(1 for r in index.collect() if r["archive"].endswith(made[0].name))
    with pytest.raises(ValueError, match="inside a record"):
        import io

        list(warc.read_records(io.BytesIO(gzip.compress(whole[: len(whole) // 2]))))


def test_gear_chunks_resist_shifts():
    draw = random.Random(8)
    data = np.frombuffer(words(draw, 800).encode(), np.uint8)
    cut = lambda d: substring.chunk_ends(d, np.flatnonzero((substring.gear_hashes(d) & substring.MASK) == 0) + 1)
    one, two = cut(data), cut(np.concatenate((np.frombuffer(b"inserted ", np.uint8), data)))
    assert len(set(one) & {x - 9 for x in two}) > 0.9 * len(one)
    assert cut(np.zeros(5000, np.uint8))[-1] == 5000 and max(np.diff([0, *cut(np.zeros(5000, np.uint8))])) <= substring.MOST


def test_passages(spark, docs, corpus, empty):
    exact = brute.substring_dedup([(d, t) for d, t, *_ in corpus], 50)
    got = {r["doc_id"]: r for r in substring.repeated_passages(clashing(docs)).collect()}
    ends = lambda raw: substring.chunk_ends(x := np.frombuffer(raw, np.uint8), np.flatnonzero((substring.gear_hashes(x) & substring.MASK) == 0) + 1) if raw else []
    want = brute.repeated_chunks([(d, t) for d, t, *_ in corpus], ends, 96)
    assert {d: [(p["start"], p["end"]) for p in r["spans"]] for d, r in got.items()} == want and want
    assert all(r["n_removed"] == sum(b - a for a, b in want[d]) and r["n_spans"] == len(want[d]) for d, r in got.items())
    assert all(d in got for d, (_, gone, *_rest) in exact.items() if gone >= 400)
    texts = {d: (t or "").encode() for d, t, *_ in corpus}
    cut = {r["doc_id"]: r["text"] for r in substring.remove_passages(docs).collect()}
    assert len(cut) == len(corpus) and all((cut[d] or "").encode() == t for d, t in texts.items() if d not in got)
    assert substring.repeated_passages(empty).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_two_stage_order(seed):
    draw = np.random.default_rng(seed)
    symbols = draw.integers(0 if seed % 2 else 97, 99 if seed % 2 else 100, 400).astype(np.uint16)
    if seed == 5:
        symbols = np.repeat(draw.integers(0, 257, 30), 12).astype(np.uint16)
    order = suffix.two_stage_order(symbols, suffix._packed(symbols))
    assert sorted(order.tolist()) == list(range(len(symbols)))
    key = lambda i: symbols[i : i + 56].tolist()
    assert all(key(a) <= key(b) for a, b in zip(order, order[1:], strict=False))
    near = suffix.shared_prefix(symbols, suffix._packed(symbols), order[order + 50 <= len(symbols)], 50)
    good = order[order + 50 <= len(symbols)]
    assert near.tolist() == [symbols[a : a + 50].tolist() == symbols[b : b + 50].tolist() for a, b in zip(good, good[1:], strict=False)]


def test_suffix_dedup(docs, corpus, empty, monkeypatch):
    want = brute.substring_dedup([(d, t) for d, t, *_ in corpus], 50)

    def run():
        return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.substring_dedup(clashing(docs)).collect()}

    assert run() == want
    monkeypatch.setattr(suffix, "MOST_CONTEXTS", 0)  # every anchor with different contexts counts as frequent
    assert run() == want
    assert suffix.substring_dedup(empty).count() == 0


def test_suffix_dedup_of_long_and_periodic_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "STRETCH", 1 << 12)  # so that texts are cut in stretches
    draw = random.Random(11)
    long = words(draw, 3000)
    rows = [(1, long), (2, words(draw, 50) + long[5000:9000] + words(draw, 900)), (3, "ab" * 300), (4, "x" + "ab" * 200), (5, "a" * 49), (6, "a" * 50), (7, "a" * 500), (8, long[:60] + "|" + long[30:120])]
    got = {r["doc_id"]: tuple(r)[1:5] for r in suffix.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.substring_dedup(rows, 50)


@pytest.mark.parametrize("case", range(5))
def test_schedule_is_fair(spark, monkeypatch, case):
    """Every block once and in order, and every source less than one block from the exact share at every slot."""
    draw = random.Random(case)
    blocks, weights = [
        ({"a": 9}, {"a": 1.0}), ({"a": 70049, "b": 29951}, {"a": 0.70049, "b": 0.29951}), ({"a": 30, "b": 5000, "c": 1}, {"a": 1e-3, "b": 1.0, "c": 0.3}),
        ({f"s{k}": draw.randint(1, 700) for k in range(37)}, {f"s{k}": draw.random() + 0.02 for k in range(37)}), ({f"s{k}": 2000 for k in range(6)}, {f"s{k}": draw.choice([0.5, 1, 2**0.5]) for k in range(6)}),
    ][case]
    monkeypatch.setattr(mixing, "FRAME", 150)  # so that there are many frames
    got = sorted((r["slot"], r["source"], r["block"]) for r in mixing.schedule(spark, blocks, weights).collect())
    total = sum(blocks.values())
    assert [x for x, *_ in got] == list(range(total))
    assert all([b for _, s, b in got if s == name] == list(range(n)) for name, n in blocks.items())
    # the fluid stream, stepped on its own: all live sources are served at their weights' shares
    done, fluid, worst = dict.fromkeys(blocks, 0), dict.fromkeys(blocks, 0.0), 0.0
    for _, name, _ in got:
        left = 1.0
        while left > 1e-12:
            live = {s: w for s, w in weights.items() if fluid[s] < blocks[s] - 1e-9}
            if not live:
                break
            rate = 1 / sum(live.values())
            step = min(left, min((blocks[s] - fluid[s]) / (w * rate) for s, w in live.items()))
            for s, w in live.items():
                fluid[s] += w * rate * step
            left -= step
        done[name] += 1
        worst = max(worst, max(abs(done[s] - fluid[s]) for s in blocks))
    assert worst < 1


def test_mixing(spark, docs, corpus, empty):
    table = docs.unionByName(docs.filter("doc_id < 5")).unionByName(docs.filter("doc_id < 3").withColumn("doc_id", F.lit(None).cast("long")))
    rows = mixing.mix(clashing(table), {"b": 3.0}, block_rows=4).collect()
    ids = [d for d, *_ in corpus]
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in rows if r["doc_id"] is not None) == sorted((False, d) for d in [*ids, *(d for d in ids if d < 5)])
    assert sum(r["doc_id"] is None for r in rows) == 3 and all(r["__n"] == "x" for r in rows)
    assert len({r["position"] for r in rows}) == len(rows)
    owner, place = {}, {}
    for r in rows:
        assert r["position"] // 4 == r["slot"] and owner.setdefault(r["slot"], (r["source"] or "", r["block"])) == (r["source"] or "", r["block"])
        place.setdefault(r["slot"], []).append(r["position"] % 4)
    assert sorted(owner) == list(range(len(owner))) and all(sorted(x) == list(range(len(x))) for x in place.values())
    sizes = {}
    for r in rows:
        sizes[r["source"] or ""] = sizes.get(r["source"] or "", 0) + 1
    plan = mixing.schedule(spark, {s: -(-n // 4) for s, n in sizes.items()}, mixing.temper(sizes, 0.5) | {"b": 3.0})
    assert {r["slot"]: (r["source"], r["block"]) for r in plan.collect()} == owner
    assert mixing.mix(empty).count() == 0 and mixing.mix(empty).columns[-3:] == ["block", "slot", "position"]
    with pytest.raises(ValueError, match="above 0"):
        mixing.mix(table, {"a": 0.0})
