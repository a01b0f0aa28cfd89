"""Queries and pipeline on the smallest tables."""

import duckdb
import pytest

import corpus_pipeline
from turnlens.llm import queries as Q
from turnlens.llm import quality

from . import brute


@pytest.fixture(scope="module")
def rows(sf_dir):
    return duckdb.connect().execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()


@pytest.mark.parametrize("name", [n for n in Q.queries() if n != "pipeline"])
def test_query_runs(spark, sf_dir, name):
    assert Q.queries()[name](spark, sf_dir).count() > 0


@pytest.mark.parametrize("name", list(Q.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("pages", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = con.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    got = sorted(map(tuple, Q.queries()[name](spark, sf_dir).select(*columns).collect()))
    assert got == sorted(cur.fetchall())


def test_stages(spark, sf_dir, rows):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-duplicates", "decontamination", "mixing"]
    docs, texts = spark.read.parquet(f"{sf_dir}/documents.parquet"), dict(rows)
    kept = corpus_pipeline.quality_stage(spark, docs, sf_dir)
    assert kept.columns == docs.columns
    passed = {r["doc_id"] for r in quality.quality_rules(docs, Q.VOCABULARY).filter("kept").select("doc_id").collect()}
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert ids == passed and all(not brute.base_rules(texts[d])[-1] for d in ids)
    # fertility rejects what it should: no document that is labelled good (its measures are tested in test_corpus)
    good = {r["doc_id"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1").collect()}
    assert not {d for d, t in texts.items() if d in good and not brute.base_rules(t)[-1]} - ids
    near = corpus_pipeline.neardup_stage(spark, docs, sf_dir)
    comps = brute.near_components(rows, 5, 80)
    assert near.columns == docs.columns and {r["doc_id"] for r in near.select("doc_id").collect()} == {d for d, (_, c) in comps.items() if c == d}
    cut = {r["doc_id"]: r["text"] for r in corpus_pipeline.line_stage(spark, docs, sf_dir).collect()}
    assert all(cut[d] == texts[d] or len(brute.WORD.findall(cut[d])) >= 50 for d in cut) and len(cut) > 0.8 * len(texts)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert len({r["position"] for r in out}) == len(out) > 0.5 * len(ids)


def test_odd_stages(spark, sf_dir):
    """Every stage takes nulls, empty and repeated rows, extra columns, and an empty table, and keeps the columns."""
    from .test_corpus import odd_tables

    rows, table, none = odd_tables(spark)
    for docs in (table, none):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            assert set(docs.columns) - {"block", "slot", "position"} <= set(out.columns) and out.count() <= docs.count()
            assert name == "mixing" or out.columns == docs.columns
    assert corpus_pipeline.neardup_stage(spark, table, sf_dir).filter("doc_id is null").count() == 2
