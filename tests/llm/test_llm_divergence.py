import random
import re
from collections import Counter

import llm_cases
from parity import compare, duck
from pyspark.sql import functions as F

from cohortlens.llm import divergence
from cohortlens.llm.queries import ORACLES, QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(rows, min_documents, top):
    """rows of (text, lang, source); every pair of sources over every kept term."""
    rows = [tuple(x or "" for x in r) for r in rows]
    found = [(lang, source, TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))) for text, lang, source in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        docs = Counter(t for group, _, terms in found if group == lang for t in set(terms))
        kept = sorted(t for t, n in docs.items() if n >= min_documents)
        sources = sorted({s for group, s, _ in found if group == lang}, key=lambda s: s.encode())
        counts = {s: Counter(t for g, x, terms in found if g == lang and x == s for t in terms) for s in sources}
        whole = sum(counts.values(), Counter())

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(counts[s]) for s in sources}, shares(whole)
        for s in sources:
            pair = [(-sum(abs(p[s][t] - p[x][t]) for t in kept), x.encode(), x) for x in sources if x != s]
            term = [(q[t] - p[s][t], t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items, limit in (("pair", pair, None), ("term", term, top)):
                out |= {(lang, s, part, x, -v, i + 1) for i, (v, _, x) in enumerate(sorted(items)[:limit])}
    return out


def got(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_against_sql(spark, folder):
    name = "op13_source_divergence"
    assert compare(spark, duck(folder), name, QUERIES[name], ORACLES[name], folder)[0] is None


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("", "é", "Z", "日")]
    made = []
    for i in range(400):
        source = rng.choice(["s1", "s2", "s10", "é", "", None, "z"])
        n = rng.choice([0, 1, 5, 40])
        text = rng.choice([" ", ", ", "9"]).join(rng.choices(vocabulary, k=n)) if rng.random() < 0.95 else None
        made.append((i, text, rng.choice(["en", "de", None]), source, None) + llm_cases.EXTRA)
    made += [(900, "alone", "xx", "one", None) + llm_cases.EXTRA, (901, "", "xx", "two", None) + llm_cases.EXTRA]
    docs = llm_cases.documents(spark, made)
    want = brute([r[1:4] for r in made], 10, 7)
    assert got(divergence.divergence(docs, 10, 7)) == want
    for name, value in (("HELD_TERMS", 5), ("HELD_CELLS", 3), ("SLICE_BYTES", 10)):  # bounds that cut work give the same rows
        monkeypatch.setattr(divergence, name, value)
    assert got(divergence.divergence(docs.repartition(5), 10, 7)) == want


def test_edges(spark):
    assert divergence.divergence(llm_cases.empty(spark)).count() == 0
    rows = llm_cases.rows()
    assert got(divergence.divergence(llm_cases.documents(spark), 2, 50)) == brute([r[1:4] for r in rows], 2, 50)


def test_paths_that_begin_alike_share_nodes(spark):
    steps = [(0, 9, 1), (1, 7, 1), (2, 5, 2)]
    schema = "lang string, path array<struct<place:int,p:long,zero:long>>, rows long"
    rows = [("en", steps, 3), ("en", steps[:2], 2), ("en", steps[1:], 4), ("de", steps[:1], 9)]
    found = {(r["lang"], r["i"], r["j"]): r["correction"] for r in divergence.pair_corrections(spark.createDataFrame(rows, schema).repartition(3)).collect()}

    def both(a, b):
        return abs(a[1] - b[1]) - abs(a[1] - b[2]) - abs(a[2] - b[1]) + abs(a[2] - b[2])

    assert found == {("en", 0, 1): 5 * both(*steps[:2]), ("en", 0, 2): 3 * both(steps[0], steps[2]), ("en", 1, 2): 7 * both(*steps[1:])}


def test_many_copies_of_one_text(spark):
    docs = spark.range(5_000).select(
        F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source")
    )
    rows = divergence.divergence(docs).collect()
    assert {(r["source"], r["item"]) for r in rows if r["part"] == "pair"} == {("a", "b"), ("b", "a")}
