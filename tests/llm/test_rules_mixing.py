"""Quality rules and mixing against plain Python."""

import hashlib
import math
import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(__file__))

from fixtures import empty, messy  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from labeltide.llm import quality_rules as q  # noqa: E402
from labeltide.llm.mixing import mix_sources, source_targets, taken_words  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[k:k + 5]) for k in range(len(w) - 4)]
    often = Counter(grams)
    cover = {p for k, g in enumerate(grams) if often[g] > 1 for p in range(k, k + 5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_counts_of_messy_rows(spark):
    docs = messy(spark).unionByName(spark.createDataFrame(
        [(900, "a b c d e a b c d e a b c d e f | x <y> #1   \x0b z\r\n\n a \n a ")], "doc_id long, text string"), allowMissingColumns=True)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")
    got = q.quality_rules(docs, labels).collect()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r[0], *r[1:4], r[4], r[5]) for r in (tuple(x[c] for c in ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) for x in got)), key=key) \
        == sorted(((i, *counts(t)) for i, t in rows), key=key)
    # Far too few labels to certify a cutoff: only the base rules reject.
    assert all(r["kept"] == (not r["base_failed"]) for r in got)
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) for r in got)


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.quality_rules(empty(spark), labels).count() == 0
    assert q.quality_rules(messy(spark), labels).where("kept").count() > 0
    assert taken_words(empty(spark)).count() == 0 and mix_sources(empty(spark)).count() == 0


def test_binomial_tail_is_exact(spark):
    cases = [(0, 300, 0.0166), (3, 400, 0.02), (60, 4000, 0.0166), (9, 500, 0.0166), (500, 600, 0.01)]
    df = spark.createDataFrame([(k, n) for k, n, _ in cases], "k long, n long")
    for k, n, p in cases:
        got = df.where((F.col("k") == k) & (F.col("n") == n)).select(q.binomial_tail(F.col("k"), F.col("n"), p)).first()[0]
        want = 1.0 if k >= n * p else math.fsum(math.comb(n, j) * p ** j * (1 - p) ** (n - j) for j in range(k + 1))
        assert abs(got - want) < 1e-9


def test_cutoffs_are_certified_per_stratum(spark):
    """3000 good rows without symbols in one stratum, of which 2% have a rate of 0.3 in the other; 30 in a third."""
    cols = "lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    rows = [("clean", 100, 1000, 0, 0, 0, 5)] * 3000 + [("noisy", 100, 1000, 300 if i % 50 == 0 else 0, 0, 0, 5) for i in range(3000)]
    rows += [(None, 100, 1000, 0, 0, 0, 5)] * 30
    cuts = {r["lang"]: r for r in q.certified_cutoffs(spark.createDataFrame(rows, cols), "lang").collect()}
    assert cuts["clean"]["cut_symbol_rate"] == q.RULES["symbol_rate"][-1]
    assert cuts["noisy"]["cut_symbol_rate"] == 0.3  # 0.25 would reject 2% of the good ones
    assert cuts[None]["cut_symbol_rate"] is None


def water_fill(sizes, weights=(5, 2, 1), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in order if s not in capped]
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return {**share, **{s: most * sizes[s] for s in capped}}
        capped |= over


def test_targets_fill_like_water(spark):
    for sizes in ({"a": 10, "b": 1000, None: 5}, {"a": 1, "b": 1, "c": 1, "d": 997}, {"x": 50}, {"é": 40, "z": 40, "Z": 40}, {"a": 0, "b": 10}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        want = water_fill(sizes)
        assert all(math.isclose(got[s], want[s], abs_tol=1e-9) for s in sizes)


def greedy_mix(rows, targets, seed=1, most=3):
    """copies by (source, id, size), sorted; each source on its own in plain Python."""
    out = []
    for source in {r[2] for r in rows}:
        own = [(i, len(WORD.findall(t or ""))) for i, t, s in rows if s == source]
        target, total = targets[source], sum(n for _, n in own)
        z = lambda n: math.isqrt(n)
        factor = None
        if target < most * total:
            sizes = sorted({n for _, n in own if n}, reverse=True)
            for n in sizes:
                held = sum(m for _, m in own if m > n)
                factor = (target - held * most) / sum(z(m) * m for _, m in own if 0 < m <= n)
                if factor * z(n) <= most:
                    break
        line, left = [], target
        for i, n in own:
            e = 0.0 if not n else float(most) if factor is None else min(factor * z(n), float(most))
            p, left = e - math.floor(e), left - math.floor(e) * n
            if p > 0:
                u = (int(hashlib.md5(f"{'' if i is None else i}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
                q = (u / (1 - u)) / (p / (1 - p))
                line.append((q / (1 + q), i is not None, i or 0, n, math.floor(e)))
            else:
                out.append((source, i, n, math.floor(e), p))
        for q, known, i, n, whole in sorted(line):
            fits = n <= left
            left -= n * fits
            out.append((source, i if known else None, n, whole + fits, None))
    return out


def test_mix_equals_plain_python(spark):
    """Several small runs, ties of all columns, sources at their limit; reruns and other splits agree."""
    docs = messy(spark, n=300).unionByName(messy(spark, n=20)).unionByName(messy(spark, n=20))
    got = taken_words(docs, run_rows=3).collect()
    assert sorted(map(str, got)) == sorted(map(str, taken_words(docs.repartition(9)).collect()))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    targets = {r["source"]: r["target"] for r in got}
    want = greedy_mix(rows, targets)
    assert sorted(str((r["source"], r["doc_id"], r["size"], r["copies"])) for r in got) == sorted(str(w[:4]) for w in want)
    for source in targets:
        own = [r for r in got if r["source"] == source]
        miss = targets[source] - sum(r["taken"] for r in own)
        assert -1e-6 <= miss and all(r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3 for r in own)
        spare = [r["size"] for r in own if r["size"] and not r["copies"]]
        assert not spare or miss < min(spare)
    mixed = mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["copies"] for r in got)


def test_odds_differ_within_a_source(spark):
    """Over many seeds a document of 400 words is drawn twice as often as one of 100."""
    rows = [(i, "w " * (400 if i % 2 else 100), "a") for i in range(300)] + [(1000, "w " * 4000, "b"), (1001, "w " * 4000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {100: 0, 400: 0}
    for seed in range(3):
        got = taken_words(docs, weights=(1, 2, 2), seed=seed).where("source = 'a'").collect()
        assert got[0]["target"] < got[0]["source_size"]
        for r in got:
            taken[r["size"]] += r["copies"]
    assert 1.6 < taken[400] / taken[100] < 2.5


def test_certified_cutoffs_equal_sql(spark):
    """Enough good rows for certificates in two strata: rows are rejected beyond the base rules, and SQL says the same of each."""
    import random

    import duckdb

    from labeltide.llm.oracle import OP8

    rnd, rows, labels = random.Random(2), [], []
    for i in range(2600):
        lang = ("en", "de", None)[0 if i < 1200 else 1 if i < 2400 else 2]
        w = [rnd.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta"]) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(12, 40))]
        if i % 4 == 3:  # not labelled good: symbols, repeated lines, repeated words of all degrees
            w += ["#$%&" * rnd.randint(1, 8)] * rnd.randint(1, 3) + w[:rnd.randint(0, 6)]
        text = " ".join(w) + "\n" + "\n".join(["line of text " + str(k % rnd.randint(1, 9)) for k in range(rnd.randint(0, 8 if i % 4 == 3 else 1))])
        rows.append((i, text, lang, "s", len(text)))
        if i % 4 != 3:
            labels.append((i, 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = q.quality_rules(docs, lab).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", lab.toPandas())
    assert sorted(map(tuple, got)) == sorted(con.execute(OP8).fetchall())
    assert sum(not r["kept"] and not r["base_failed"] for r in got) > 100
    kept = q.accepted(docs.withColumn("kept", F.lit("x")).withColumn("_row", F.lit(1)), lab)
    assert kept.columns == [*docs.columns, "kept", "_row"]
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in got if r["kept"])
