import hashlib
import random
from collections import Counter
from itertools import accumulate

import llm_cases
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import ByteLevel

import public_tokenizers
from cohortlens.llm import alignment
from cohortlens.llm.queries import QUERIES


def byte_alphabet():
    """Characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in plain)}


@pytest.fixture(scope="module")
def tools():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    alphabet = byte_alphabet()
    assert set(alphabet) == set(ByteLevel.alphabet())
    return tokenizer, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), alphabet


def tokens(tools, text):
    """(A ids, A bytes, B ids, B bytes) of a text by the libraries themselves, empty where they don't join to the text."""
    tokenizer, pieces, alphabet = tools
    if not text:
        return [], [], [], []
    a = tokenizer.encode(" " + text, add_special_tokens=False).ids
    b = pieces.encode(text)
    raw_a = [bytes(alphabet[c] for c in tokenizer.id_to_token(i)) for i in a]
    raw_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, pieces.id_to_piece(i)) for i in b)]
    whole = (" " + text).encode()
    return (a, raw_a, b, raw_b) if b"".join(raw_a) == whole == b"".join(raw_b) else ([], [], [], [])


def brute(tools, rows):
    docs, counts = [], Counter()
    for doc_id, text in rows:
        a, raw_a, b, raw_b = tokens(tools, text)
        spans, links = [], []
        for ids, raw in ((a, raw_a), (b, raw_b)):
            at, found = 0, []
            for token, piece in zip(ids, raw):
                found.append((at, at + len(piece), token))
                at += len(piece)
            spans.append(found)
        first = 0
        for x, y, i in spans[0]:
            while first < len(spans[1]) and spans[1][first][1] <= x:
                first += 1
            at = first
            while at < len(spans[1]) and spans[1][at][0] < y:
                links.append((i, spans[1][at][2]))
                at += 1
        shared = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups, ia, ib = [], 0, 0
        for end in shared:
            ja, jb = ia, ib
            while ja < len(a) and spans[0][ja][1] <= end:
                ja += 1
            while jb < len(b) and spans[1][jb][1] <= end:
                jb += 1
            groups.append((a[ia:ja], b[ib:jb]))
            ia, ib = ja, jb
        docs.append((doc_id, len(a), len(b), groups, links))
        counts.update(links)
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for doc_id, n_a, n_b, groups, links in docs:
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        digest = hashlib.sha256(said.encode()).hexdigest() if groups else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

HARD = [
    "a  b", " a", "a ", "a\n\nb", "\na", "a\n", "a \n b", "a\tb c", "x\0y z", "a▁b", "▁", "<0x41> <s> <|endoftext|> </s>", " x y", "it's 12 345,6 — don't",
    "日本語 の é é", "\U0001f600\U0001f600 ok", "a\r\nb", "  \n \n  ", " ", "\n", "\x1ca b\x1d", "a　b c", "﻿x", "ab" * 3000, "if (x):\n    return y\n",
    "word " * 50 + "end", "  x", "1 2  3   4    5     6", "ﬁ ① ½", "{\r\n\t}", "a ́b", "<unk>", "\x7f\x01 \x02",
]


def test_whole_query(spark, folder, tools):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op11_tokenizer_alignment"](spark, folder)
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == brute(tools, rows)


def test_hard_texts_and_rare_pairs(spark, tools, monkeypatch):
    rng = random.Random(2)
    made = [(i, t, "en", "s", None) + llm_cases.EXTRA for i, t in enumerate(HARD)]
    for i in range(200):
        text = "".join(rng.choice(HARD)[: rng.randrange(1, 9)] + rng.choice([" ", "", "\n", "  ", " \n", "\t"]) for _ in range(rng.randrange(1, 9)))
        made.append((100 + i, text, None, None, None) + llm_cases.EXTRA)
    made += llm_cases.rows()
    docs = llm_cases.documents(spark, made).repartition(3)
    want = brute(tools, [r[:2] for r in made])
    pairs = alignment.pair_counts(docs)
    for limit in (alignment.HEAD_PAIRS, 20, 0):
        got = alignment.with_tail(alignment.digest(alignment.grouped(docs, pairs, limit)), pairs, pairs.count() > limit)
        assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == want
    for name, value in (("SLICE_BYTES", 50), ("ENCODED", 3), ("HELD_PAIRS", 5)):
        monkeypatch.setattr(alignment, name, value)
    pairs = alignment.pair_counts(docs)
    got = alignment.digest(alignment.grouped(docs, pairs)).drop("tail")
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == want


def test_groups_are_real_tokens(spark, tools):
    docs = llm_cases.documents(spark)
    by_text = {t: tokens(tools, t) for t in {r[1] for r in llm_cases.rows()}}
    rows = alignment.align(docs, head_pairs=5).join(docs.select("doc_id", "text").distinct(), "doc_id").collect()
    assert rows
    for r in rows:
        a, raw_a, b, raw_b = by_text[r["text"]]
        if r["doc_id"] == 7:
            continue  # rows of two texts share the id
        assert (r["a_ids"], r["b_ids"]) == (a, b)
        assert len(r["a_ends"]) == len(r["b_ends"])
        (at_a, at_b) = ([0, *accumulate(map(len, raw))] for raw in (raw_a, raw_b))
        assert [at_a[x] for x in r["a_ends"]] == [at_b[y] for y in r["b_ends"]]


def test_edges(spark):
    empty = llm_cases.empty(spark)
    assert alignment.align(empty).count() == 0
    none = llm_cases.documents(spark, [(1, None, None, None, None) + llm_cases.EXTRA, (None, "", None, None, None) + llm_cases.EXTRA])
    rows = alignment.align(none).collect()
    assert len(rows) == 2 and all(r["a_ids"] == [] and r["a_ends"] == [] and (r["n_links"], r["n_best"], r["count_sum"]) == (0, 0, 0) for r in rows)


def test_many_copies(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("one two, three").alias("text"))
    got = alignment.align(docs, head_pairs=1).agg(F.count_distinct("count_sum").alias("n"), F.min("count_sum").alias("s"), F.min("n_links").alias("l")).first()
    assert got["n"] == 1 and got["s"] >= 3_000 * got["l"]
