"""Small tables with everything that may go wrong in them."""

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, id long, score double, "
          "kept boolean, n_words long, shard int, target double, rank double, bin int, v long, u long, rep long, item string, digest string")


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(["", "", ",", "."]) for _ in range(n))


def messy_rows(seed=3, n=60):
    """Plain texts, exact and near copies, nulls in every column, empty and very long texts, repeated rows and ids."""
    rnd = random.Random(seed)
    texts = [sentence(rnd, rnd.randint(12, 90)) for _ in range(n)]
    texts += texts[:10]  # exact copies
    for t in texts[10:20]:  # near copies
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    texts += [None, "", " \n\t ", "one", "two words", "Ünïcödé " * 4, "x" * 30_000, sentence(rnd, 9_000), "same line here now\n" * 30]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["a", "b", "c", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5]]  # repeated rows
    rows += [(None, texts[3], "en", "a", 1), (None, None, None, None, None), (7, "another text under a known id " * 3, "en", "b", None)]
    return [r + (9, 9, 0.5, None, 9, 9, 9.0, 9.0, 9, 9, 9, 9, "x", "y") for r in rows]


def messy(spark, **kw):
    return spark.createDataFrame(messy_rows(**kw), SCHEMA).repartition(4)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
