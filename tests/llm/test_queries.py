"""Registered queries run over the smallest tables; the pipeline agrees with its stages done plainly."""

import pytest
from tests.llm.test_dedup import brute_components, brute_cut
from tests.llm.test_text import brute_scan

from alnquant.llm import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    table = "pages" if name.split("_")[0] in ("op3", "op7") else "conversations" if name.startswith("op2") else "documents"
    assert df.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_pipeline(spark, sf):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = P.keep_quality(spark, docs, sf)
    accepted = [(r["doc_id"], r["text"]) for r in kept.orderBy("doc_id").collect()]
    one = [d for d, _, c in brute_components(accepted, 5, 80) if d == c]
    texts = dict(accepted)
    left = [(d, texts[d]) for d in one]
    cut = {d: n for d, _, n, _, _ in brute_cut(left, 50)}
    final = {r["doc_id"]: r for r in P.run(spark, sf).collect()}
    got = {d: texts[d] for d in one if cut[d] == 0 or d in final}
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {x[0] for x in brute_scan([(d, t) for d, t in got.items() if cut[d] == 0], bench) if x[5] or x[2] >= 13}
    assert {d for d in one if cut[d] == 0} - dirty == {d for d in final if cut[d] == 0}
    for d, r in final.items():
        assert r["round_trip"] and (cut[d] or r["decoded"] == (texts[d] or "")) and r["n_ids"] == len(r["ids"])


def test_pipeline_stages_on_odd_rows(spark, sf):
    """Repeated rows, null and repeated ids, null texts, extra columns and empty tables."""
    import corpus_pipeline as P

    a, b = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    rows = [(1, a), (1, a), (2, b), (2, a + " more"), (3, b), (None, a), (None, "x y"), (None, "x y"), (7, None), (8, ""), (8, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1, "clash") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    got = P.keep_one_of_near_copies(spark, docs, sf)
    assert got.columns == P.COLUMNS
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, a), (2, b), (None, "x y"), (7, None), (8, ""), (8, "")], key=str)
    for _, stage in P.STAGES:
        assert stage(spark, docs.where("false"), sf).count() == 0
    assert P.keep_uncontaminated(spark, docs, sf).count() == len(rows)
    assert P.cut_repeats(spark, docs.where("doc_id is null or doc_id < 3"), sf).columns == P.COLUMNS


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, sf, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf)
    cols = sorted(got.columns)
    cur = con.execute(queries.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    want = sorted(tuple(str(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(tuple(str(r[c]) for c in cols) for r in got.collect()) == want
