import hashlib

import llm_cases
from parity import compare, duck
from pyspark.sql import functions as F

from cohortlens.llm import exact
from cohortlens.llm.queries import ORACLES, QUERIES


def test_against_sql(spark, folder):
    assert compare(spark, duck(folder), "op10", QUERIES["op10_exact_dedup"], ORACLES["op10_exact_dedup"], folder)[0] is None


def test_edges(spark):
    rows = llm_cases.rows()
    got = exact.group_copies(llm_cases.documents(spark)).collect()
    assert len(got) == len(rows)
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    for r in got:
        text = next(t for t, ids in groups.items() if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        ids = groups[text]
        assert r["group_size"] == len(ids) and r["keep_id"] == max((i for i in ids if i is not None), default=None)
    assert sum(r["kept"] for r in got) == len(groups)
    assert exact.group_copies(llm_cases.empty(spark)).count() == 0


def test_keep_one_keeps_all_columns(spark):
    docs = llm_cases.documents(spark)
    kept = exact.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r[1] or "" for r in llm_cases.rows()})
    assert exact.keep_one(llm_cases.empty(spark)).count() == 0


def test_buckets_split_until_they_fit(spark):
    docs = spark.range(5000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    index = exact.build_index(docs, capacity=100)
    sizes = index.groupBy("bucket", "local_depth").count().collect()
    assert max(r["count"] for r in sizes) <= 100 and len({r["local_depth"] for r in sizes}) >= 1
    assert index.count() == 5000 and index.where("link <> 1").count() == 0
    # a bucket holds every key with its leading bits, and no other bucket has them
    depth = max(r["local_depth"] for r in sizes)
    assert len({r["bucket"] for r in sizes}) == len(sizes) <= 2**depth


def test_one_text_may_fill_the_table(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text"))
    got = exact.group_copies(docs).agg(F.sum(F.col("kept").cast("int")).alias("k"), F.min("group_size").alias("n"), F.min("keep_id").alias("i")).first()
    assert (got["k"], got["n"], got["i"]) == (1, 20_000, 19_999)


def test_rows_that_stay_are_looked_up_in_the_index(spark):
    """Both forms read the stored index through its directory; buckets smaller than the table give the same rows."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 > 0 THEN concat('t', id % 700) END AS text", "id * 2 AS other")
    want = {(r["text"] or ""): r["doc_id"] for r in docs.orderBy("doc_id").collect()}
    kept = exact.keep_one(docs.union(docs.where("doc_id > 2900")), capacity=16)
    assert any("exact-index-" in f for f in kept.inputFiles())
    rows = kept.collect()
    assert {(r["text"] or ""): r["doc_id"] for r in rows} == want and len(rows) == len(want) and all(r["other"] == 2 * r["doc_id"] for r in rows)
    assert {r["doc_id"] for r in exact.group_copies(docs, capacity=16).where("kept").collect()} == set(want.values())
