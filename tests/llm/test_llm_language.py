import zlib

import llm_cases
import numpy as np
import pytest

from cohortlens.llm import language


def naive_phrases(codes, training):
    """Phrases of a greedy parse: each the longest start of the rest that occurs in the training text."""
    text, n, at = bytes(codes), 0, 0
    while at < len(text):
        width = 0
        while at + width < len(text) and text[at : at + width + 1] in training:
            width += 1
        at += max(1, width)
        n += 1
    return n


def test_parse_against_brute_force():
    rng = np.random.default_rng(1)
    training = bytes(rng.integers(1, 6, 400, np.uint8))
    table = language.transitions(training, 8)
    blocks = sorted((rng.integers(0, 8, int(n)).astype(np.uint8) for n in rng.integers(1, 90, 60)), key=len, reverse=True)
    assert language.count_phrases(blocks, table).tolist() == [naive_phrases(b, training) for b in blocks]


def model(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog and the house", "en"), ("der hund und die katze und das haus", "de")] * 40)]
    return language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_edges(spark):
    fitted = model(spark)
    assert [lang for lang, _ in fitted.texts] == ["de", "en"]
    made = {r["doc_id"]: r for r in language.identify(llm_cases.documents(spark), fitted).collect()}
    for doc in (4, 5, 6, 11, None):
        assert made[doc]["lang_pred"] in (("und",) if doc is not None else ("und", "en", "de"))
    assert made[4]["score"] == 0.0 and made[13]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in made.values())
    assert len(language.identify(llm_cases.documents(spark), fitted).collect()) == len(llm_cases.rows())
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in made.values())
    assert language.identify(llm_cases.empty(spark)).count() == 0


def test_nothing_learned(spark):
    docs = spark.createDataFrame([(1, "a text", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {(r["lang_pred"], r["score"]) for r in language.identify(docs).collect()} == {("und", 0.0)}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 100 and np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.98


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = [(i, "abc abd" if i % 2 else "xyz xzy", ("a" if i % 2 else "x")) for i in range(60)]
    spoiled = [(i, t, "wrong" if zlib.crc32(str(i).encode()) % 5 == 0 else lang) for i, t, lang in docs]
    frames = [spark.createDataFrame(d, "doc_id long, text string, lang string") for d in (docs, spoiled)]
    assert language.fit(frames[0]) == language.fit(frames[1])


@pytest.mark.parametrize("length", [language.BLOCK - 1, language.BLOCK, 3 * language.BLOCK + 5])
def test_long_texts_are_read_whole(length):
    fitted = language.LanguageModel("ab", (("a", bytes([2] * 50)), ("b", bytes([3] * 50))))
    names, _ = language.classify(["a" * 100 + "b" * length, "b" * 100 + "a" * length], fitted)
    assert names == ["b", "a"]


def test_sparse_parse_against_brute_force():
    rng = np.random.default_rng(2)
    values = np.concatenate(([0, 1], rng.integers(2, 70_000, 5)))
    training = rng.choice(values, 400).tolist()
    table = language.SparseTransitions(training, 70_000)
    blocks = sorted((rng.choice(np.append(values, 9), int(n)).astype(np.uint32) for n in rng.integers(1, 90, 60)), key=len, reverse=True)
    runs = {tuple(training[a:b]) for a in range(400) for b in range(a + 1, min(a + 30, 401)) if 0 not in training[a:b]}

    def naive(block):
        at = n = 0
        while at < len(block):
            width = 0
            while at + width < len(block) and tuple(block[at : at + width + 1]) in runs:
                width += 1
            at, n = at + max(1, width), n + 1
        return n

    assert language.count_phrases(blocks, table).tolist() == [naive(b.tolist()) for b in blocks]


def test_letters_of_large_scripts_are_all_learned(spark):
    rng = np.random.default_rng(3)
    spans = {"han": (0x4E00, 400), "hangul_a": (0xAC00, 300), "hangul_b": (0xB400, 300), "latin": (0x61, 26)}
    text = lambda lang: " ".join("".join(chr(spans[lang][0] + int(i)) for i in rng.integers(0, spans[lang][1], 4)) for _ in range(60))
    rows = [(i, text(lang), lang) for i, lang in enumerate(sorted(spans) * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fitted = language.fit(docs)
    assert len(fitted.letters) == sum(n for _, n in spans.values())
    got = language.identify(docs, fitted).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang"] == r["lang_pred"] for r in got)


def test_unknown_letters_do_not_match_each_other():
    table = language.transitions(bytes([0] * 50), 3)
    assert language.count_phrases([np.zeros(20, np.uint8)], table).tolist() == [20]


def test_slices_hold_every_text_in_order(monkeypatch):
    monkeypatch.setattr(language, "SLICE_CHARS", 10)
    texts = ["abc", None, "", "a" * 50, "abcdefgh", "ij", "k", None]
    slices = list(language._slices(texts))
    assert [t for s in slices for t in s] == texts and len(slices) == 3
    assert list(language._slices([])) == []
