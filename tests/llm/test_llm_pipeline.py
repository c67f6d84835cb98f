import gc
import weakref

import llm_cases
import pyarrow as pa
from test_llm_minhash import brute as near_brute
from test_llm_packing import check_places

import corpus_pipeline
from cohortlens.llm import decontaminate, language, texts, tokens


def test_stages_against_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    last = {t: i for i, t in sorted(rows.items())}
    rows = {i: t for t, i in last.items()}
    groups = near_brute(list(rows.items()))
    rows = {i: t for i, t in rows.items() if groups[i] == i}
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    bad = decontaminate.contamination(docs, bench).where("contaminated").collect()  # itself held against brute force
    rows = {i: t for i, t in rows.items() if i not in {r["doc_id"] for r in bad}}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in got} == rows.keys()
    check_places(got, 2048)


def test_stage_names_and_columns(spark, folder):
    assert len(corpus_pipeline.STAGES) == 5
    docs = llm_cases.documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
        assert stage(spark, llm_cases.empty(spark), folder).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, llm_cases.empty(spark), folder).count() == 0


def test_language_stage_drops_only_texts_without_letters(spark, folder):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(["words here", "123", None, "", "ünï", "…"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.keep_known_languages(spark, docs, folder)
    assert {r["doc_id"] for r in kept.collect()} == {0, 4} and language.UNDETERMINED == "und"


def test_a_worker_keeps_nothing_of_the_stage_before():
    """One process runs the kernels of all stages, as an executor's worker does: the automata go when words or tokens come."""
    codes = bytes([2, 3, 1, 3, 2] * 50)
    for later in (lambda: texts.shingles("some words of a text here"), lambda: list(tokens.encoder().encode(pa.array(["some words"])))):
        model = language.LanguageModel("ab", (("x", codes),))
        assert language.classify(["abba", "ab ab"], model)[0] == ["x", "x"]
        held = weakref.ref(language._prepare(model)[1][0])
        later()
        gc.collect()
        assert held() is None
    encoder = weakref.ref(tokens.encoder())
    assert encoder() is tokens.encoder()  # the same operator's memory stays from batch to batch
    assert len(texts.shingles("some words of a text here")) == 2
    gc.collect()
    assert encoder() is None
