"""The registered queries on the smallest tables, and the pipeline's stages on a table of their own."""

import re

import pytest

import corpus_pipeline
from framegrid.llm import queries

duckdb = pytest.importorskip("duckdb")
QUERIES, ORACLE = queries.queries(), queries.oracle_sql()


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    rows = QUERIES[name](spark, sf_dir).toPandas()
    table = "pages" if name in ("op1_warc", "op3_html") else "documents"
    n = spark.read.parquet(f"{sf_dir}/{table}.parquet").count()
    if name not in ("op2_decontamination", "op5_packing"):
        assert len(rows) == n
    if name in ORACLE:
        con = duckdb.connect()
        for t in ("documents", "pages", "labels", "benchmark"):
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        want = con.sql(ORACLE[name]).df()
        assert sorted(want) == sorted(rows)
        key = [want.columns[0]]
        a, b = rows[list(want)].sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True)
        for c in want:
            x, y = a[c].astype(object).where(a[c].notna(), None), b[c].astype(object).where(b[c].notna(), None)
            assert x.tolist() == y.tolist(), c


def test_stages_keep_columns_and_apply_their_decisions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == columns, name
        kept = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert kept <= ids
        ids, docs = kept, out
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids
    from framegrid.llm import decontam, simhash

    assert decontam.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).count() == 0
    assert simhash.near_duplicates(docs).filter("id <> component_id").count() == 0


def test_a_sessions_own_batch_size_is_left_alone(spark):
    from framegrid.llm.common import map_batches

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "123")
        map_batches(spark.range(3), lambda it: it, "id long").collect()
        assert spark.conf.get(key) == "123"
        spark.conf.set(key, "10000")
        map_batches(spark.range(3), lambda it: it, "id long").collect()
        assert spark.conf.get(key) == "500"
    finally:
        spark.conf.set(key, before)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, framegrid_stat_n_words long, fp string"


def odd_documents(spark, sf_dir):
    """Null ids and texts, empty, wordless, repeated, tied and very long rows, and columns with clashing names."""
    own = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    long = " ".join(f"word{i % 4099} is one of {i} in a line," for i in range(40_000))
    rows = [*own, *own[:5], (None, own[7][1], None), (None, None, "en"), (900, None, None), (901, "", "en"), (902, " \n ", "en"), (903, "...", None), (904, long, "en"), (904, own[9][1], "en")]
    return spark.createDataFrame([(i, t, x, None, None, 1, "clash") for i, t, x in rows], DOCS)


@pytest.mark.parametrize("rows", ["odd", "empty"])
def test_pipeline_takes_odd_rows_and_empty_tables(spark, sf_dir, tmp_path, rows):
    docs = odd_documents(spark, sf_dir)
    docs = docs if rows == "odd" else docs.limit(0)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        assert out.count() <= n
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert (len(packed) > 0) == (rows == "odd")
    assert all(0 < r["length"] <= 2048 for r in packed)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op1_warc", "op3_html"}))
def test_operators_take_odd_rows(spark, sf_dir, tmp_path, name):
    docs = odd_documents(spark, sf_dir)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    got = QUERIES[name](spark, str(tmp_path)).collect()
    if name not in ("op2_decontamination", "op5_packing"):
        assert len(got) == docs.count()
    if name == "op5_packing":
        assert sum(r["start"] == 0 for r in got) == docs.count()
