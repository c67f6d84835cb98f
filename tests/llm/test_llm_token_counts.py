import tempfile

import llm_cases
import pytest
from tokenizers import Tokenizer

from cohortlens.llm import token_counts, tokens
from cohortlens.llm.queries import QUERIES

HF = Tokenizer.from_file(tokens.JSON_PATH)


def brute(rows):
    totals = {}
    for _, text, lang, source in rows:
        text = text or ""
        for version, n in ((token_counts.BPE, len(HF.encode(text, add_special_tokens=False).ids)), (token_counts.WORDS, len(text.split()))):
            old = totals.get((source, lang, version), (0, 0, 0))
            totals[source, lang, version] = (old[0] + 1, old[1] + n, old[2] + len(text))
    return totals


def totals(rollup):
    return {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"], r["chars"]) for r in rollup.totals().collect()}


def test_query_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{folder}/labels.parquet").where("toxic = 1").collect()}
    got = {(r["source"], r["lang"], r["tokenizer"]): (r["docs"], r["tokens"], r["chars"]) for r in QUERIES["op2_token_counts"](spark, folder).collect()}
    assert got == brute([tuple(r) for r in docs if r["doc_id"] not in toxic])


@pytest.fixture
def rollup(spark):
    return token_counts.Rollup(spark, tempfile.mkdtemp(prefix="rollup-"))


def test_batches(spark, rollup):
    schema = "doc_id long, text string, lang string, source string"
    rows = [(1, "a b c", "en", "s"), (2, "d e", "en", "s"), (3, "f", "fr", "t"), (2, "d e", "en", "s"), (None, "g h", "en", "s"), (4, None, None, None)]
    counted = lambda r: token_counts.counted(spark.createDataFrame(r, schema))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "doc_id long")
    assert totals(rollup) == {}
    rollup.insert(1, counted(rows))
    assert totals(rollup) == brute(rows)
    rollup.insert(1, counted(rows))  # again
    assert totals(rollup) == brute(rows)
    rollup.revise(2, counted([(1, "a b c d e f", "de", "s"), (9, "new", "fr", "t")]))
    rows = [(1, "a b c d e f", "de", "s"), *rows[1:], (9, "new", "fr", "t")]
    assert totals(rollup) == brute(rows)
    for _ in range(2):
        rollup.delete(3, ids(2, 3, 77, None))  # both rows of 2; 77 and null are unknown
        assert totals(rollup) == brute([r for r in rows if r[0] not in (2, 3)])
    rollup.revise(2, counted([(1, "shorter", "en", "s"), (9, "new", "fr", "t")]))  # batch 2 once more, put right
    assert totals(rollup) == brute([(1, "shorter", "en", "s")] + [r for r in rows if r[0] not in (1, 2, 3)])


def test_unfinished_batches_do_not_count(spark, rollup):
    rows = [(1, "a b", "en", "s")]
    counted = token_counts.counted(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    rollup.insert(1, counted)
    counted.write.parquet(rollup._path("changes", 2))  # a writer died before its deltas
    assert totals(rollup) == brute(rows)


@pytest.mark.parametrize("step", ["_sum_up", "_publish"])
def test_a_retry_that_dies_leaves_the_batch_as_published(spark, rollup, monkeypatch, step):
    schema = "doc_id long, text string, lang string, source string"
    counted = lambda rows: token_counts.counted(spark.createDataFrame(rows, schema))
    rows = [(1, "a b c", "en", "s"), (2, "d", "fr", "t")]
    rollup.insert(1, counted(rows))

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m, pytest.raises(RuntimeError):
        m.setattr(rollup, step, die)
        rollup.insert(1, counted([(1, "other words here now", "en", "s")]))
    assert totals(rollup) == brute(rows)
    rollup.delete(2, spark.createDataFrame([(1,), (2,)], "doc_id long"))
    assert totals(rollup) == {}
    rollup.insert(1, counted(rows))  # the retry done at last
    assert totals(rollup) == {}


def test_edges(spark, rollup):
    docs = llm_cases.documents(spark)
    rollup.insert(1, token_counts.counted(docs))
    assert totals(rollup) == brute([(r[0], r[1], r[2], r[3]) for r in llm_cases.rows()])
    rollup.insert(2, token_counts.counted(llm_cases.empty(spark)))
    rollup.insert(3, token_counts.provisional(llm_cases.empty(spark)))
    assert totals(rollup) == brute([(r[0], r[1], r[2], r[3]) for r in llm_cases.rows()])
    guessed = token_counts.provisional(docs).agg({"tokens": "min", "chars": "min"}).first()
    assert min(guessed) == 0  # null and negative n_chars


def test_documents_without_id_are_counted_once(spark, rollup):
    docs = llm_cases.documents(spark)
    rollup.insert(1, token_counts.provisional(docs))
    rollup.revise(2, token_counts.counted(docs))
    assert totals(rollup) == brute([(r[0], r[1], r[2], r[3]) for r in llm_cases.rows()])
