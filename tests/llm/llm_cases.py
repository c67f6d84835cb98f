"""Small tables the tests of the text operators share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key string, id int, bucket string, rank int, length int, kept string"
EXTRA = (1, "k", 2, "b", 3, 4, "x")  # columns whose names clash with names the operators use inside


def words(seed, n):
    rng = random.Random(seed)
    return [rng.choice("lo mi ra ten vas quor pel dun hesk tarn") + rng.choice("a e i o u an el or".split()) + str(rng.randrange(60)) for _ in range(n)]


def rows():
    base = words(1, 120)
    near = base[:60] + ["changed"] + base[61:]
    long = " ".join(words(2, 30_000))
    texts = {
        1: " ".join(base), 2: " ".join(near), 3: " ".join(base), 4: None, 5: "", 6: "   \n\t ", 7: "one two", 8: "ONE Two", 9: long,
        10: "ñandú über ça — 日本", 11: "12 34 !!", 12: long + " tail", 13: "Is it the one and only test of this?",
    }
    made = [(i, t, "en" if i % 2 else "fr", "s", None) for i, t in texts.items()]
    made += [(7, "one two", "en", "s", 7), (7, "one two", "en", "s", 7)]  # repeated rows
    made += [(None, " ".join(base), None, None, None), (None, None, None, None, None), (-3, "one two", None, None, -5)]
    return [r + EXTRA for r in made]


def documents(spark, made=None):
    return spark.createDataFrame(rows() if made is None else made, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
