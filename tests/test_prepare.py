import math
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from labeltide.operators import metrics, ordering, prepare


def test_forward_fill_matches_pandas_across_buckets(spark):
    rng = random.Random(7)
    n = 5000
    vals = [None] + [rng.choice([None, None, 1, 2, 3]) for _ in range(n - 1)]
    txt = [rng.choice([None, "a", "b"]) for _ in range(n)]
    pdf = pd.DataFrame({"ord": range(n), "v": vals, "t": txt})
    want = pdf.ffill()
    df = spark.createDataFrame([(i, v, t) for i, v, t in zip(range(n), vals, txt)],
                               "ord long, v int, t string")
    for width in (7, 64, 1 << 20):
        got = (prepare.forward_fill(df, ["v", "t"], "ord", ranges=width)
               .orderBy("ord").toPandas())
        assert got["ord"].tolist() == list(range(n))
        for c in ("v", "t"):
            exp = [None if (isinstance(x, float) and math.isnan(x)) or x is None else x
                   for x in want[c].tolist()]
            g = [None if (isinstance(x, float) and math.isnan(x)) or x is None else x
                 for x in got[c].tolist()]
            assert g == exp, (width, c)


def test_dense_row_number_sparse_ids(spark):
    # monotonically_increasing_id style gaps between partitions
    ids = [p * (1 << 33) + i for p in range(4) for i in range(50)]
    df = spark.createDataFrame([(x,) for x in ids], "o long")
    got = ordering.dense_row_number(df, "o", "rn", ranges=16).orderBy("o").collect()
    assert [r.rn for r in got] == list(range(1, len(ids) + 1))


@pytest.mark.parametrize("n,frac", [(1000, 0.1), (37, 0.3), (5, 0.5), (200, 0.0), (50, 1.0)])
def test_holdout_exact_and_reproducible(spark, n, frac):
    df = spark.range(n).withColumnRenamed("id", "doc_id")
    a = prepare.holdout_split(df, frac, "doc_id")
    rows = a.collect()
    held = sorted(r.doc_id for r in rows if r.split == "dev")
    assert len(rows) == n
    assert len(held) == math.ceil(n * frac)
    import hashlib
    want = sorted(sorted(range(n), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())
                  [:math.ceil(n * frac)])
    assert held == want
    again = sorted(r.doc_id for r in prepare.holdout_split(df, frac, "doc_id").collect()
                   if r.split == "dev")
    assert again == held


def test_stratified_split_per_group(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(300)]
    df = spark.createDataFrame(rows, "id long, g string")
    out = prepare.stratified_split(df, 0.25, "id", by="g").collect()
    for g in ("a", "b"):
        n = sum(1 for r in out if r.g == g)
        k = sum(1 for r in out if r.g == g and r.split == "dev")
        assert k == math.ceil(n * 0.25)
    train, dev = prepare.split_frames(prepare.stratified_split(df, 0.25, "id", by="g"))
    assert train.count() + dev.count() == 300
    assert train.join(dev, "id").count() == 0


def test_dedup_rows_and_text(spark):
    df = spark.createDataFrame(
        [(0, "x", "1"), (1, "x", "1"), (2, "y", "1"), (3, "x", "2"), (4, None, "1"), (5, None, "1")],
        "row_ord long, text string, label string")
    got = sorted(tuple(r) for r in prepare.dedup_rows(df, "row_ord").collect())
    assert got == [(0, "x", "1"), (2, "y", "1"), (3, "x", "2"), (4, None, "1")]
    first = sorted(tuple(r) for r in prepare.dedup_text(df, "text", "row_ord").collect())
    assert first == [(0, "x", "1"), (2, "y", "1"), (4, None, "1")]


def test_union_value_counts_labels_preview(spark):
    a = spark.createDataFrame([(1, "p")], "id long, text string")
    b = spark.createDataFrame([(2, "q", "L")], "id long, text string, label string")
    u = prepare.union_datasets([a, b], ["a", "b"]).orderBy("id").collect()
    assert u[0].label is None and u[1].label == "L" and u[1].source == "b" and u[1].source_rank == 1
    df = spark.createDataFrame([(i, v) for i, v in enumerate("bbaac") ] + [(9, None)], "o long, v string")
    vc = [tuple(r) for r in prepare.value_counts(df, "v").collect()]
    assert vc == [("a", 2), ("b", 2), ("c", 1)]
    dl = [r.v for r in prepare.distinct_labels(df, "v", "o").collect()]
    assert dl == ["b", "a", "c"]
    assert [r.o for r in prepare.preview(df, "o", 2).collect()] == [0, 1]
    assert prepare.row_count(df) == 6


def test_align_unmatched_and_duplicates(spark):
    pred = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c")], "id string, p string")
    gold = spark.createDataFrame([("2", "x"), ("3", "y"), ("4", "z")], "id string, g string")
    assert sorted(r.id for r in prepare.align_by_id(pred, gold, "id").collect()) == ["2", "3"]
    um = sorted(tuple(r) for r in prepare.unmatched(pred, gold, "id").collect())
    assert um == [("1", "prediction"), ("4", "gold")]
    dup = gold.unionByName(gold)
    with pytest.raises(ValueError):
        prepare.align_by_id(pred, dup, "id")


def test_defaults_update_shuffle(spark):
    df = spark.createDataFrame([(1, "0"), (2, "1"), (3, "7")], "id long, pred string")
    df = prepare.with_default_column(df, "prediction", "")
    df = prepare.filter_update(df, F.col("pred") == "0", "prediction", "HOF")
    assert [r.prediction for r in df.orderBy("id").collect()] == ["HOF", "", ""]
    s1 = [r.id for r in prepare.shuffle(df, "id", 3).collect()]
    s2 = [r.id for r in prepare.shuffle(df, "id", 3).collect()]
    assert s1 == s2 and sorted(s1) == [1, 2, 3]


def test_sparse_ids_give_one_global_row_per_range(spark):
    df = spark.range(5000).select((F.col("id") * (1 << 22)).alias("o"), F.when(F.col("id") % 7 == 0, F.col("id")).alias("v"))
    ranged = ordering.in_ranges(df, "o", 8)
    assert ranged.select(ordering.RANGE).distinct().count() <= 8
    got = ordering.dense_row_number(df, "o", "rn", ranges=8).collect()
    assert all(r.rn == r.o // (1 << 22) + 1 for r in got)
    filled = prepare.forward_fill(df, ["v"], "o", ranges=8).collect()
    assert all(r.v == r.o // (1 << 22) // 7 * 7 for r in filled)


def test_null_stratum_is_a_group(spark):
    df = spark.createDataFrame([(i, None if i < 50 else "x") for i in range(80)], "id long, g string")
    got = {(r.g, r.split): r["count"] for r in prepare.stratified_split(df, 0.2, "id", by="g").groupBy("g", "split").count().collect()}
    assert got == {(None, "dev"): 10, (None, "train"): 40, ("x", "dev"): 6, ("x", "train"): 24}


def test_text_never_crosses_the_network_in_dedup(spark):
    df = spark.range(100).select("id", F.concat(F.lit("t"), F.col("id") % 10).alias("text"))
    plan = prepare.first_orders(df, "text", "id")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    assert sorted(r.id for r in prepare.dedup_text(df, "text", "id").collect()) == list(range(10))


def test_splits_are_exact_where_keys_repeat(spark):
    """Few keys, rows that repeat in full, null keys and groups: always ceil(n * frac), the same rows in every layout."""
    rows = [(k % 4 if k % 9 else None, "g" if k % 3 else None, k // 40) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, g string, v long")
    for by in (None, "g"):
        for frac in (0.0, 0.1, 0.25, 0.5, 1.0):
            marked = prepare.stratified_split(df.repartition(5), frac, "k", by)
            held = sorted(str(r) for r in marked.where("split = 'dev'").collect())
            for group in ([None] if by is None else ["g", None]):
                mine = [r for r in rows if by is None or r[1] == group]
                got = [x for x in held if by is None or f"g={group!r}" in x]
                assert len(got) == math.ceil(len(mine) * frac)
            again = prepare.stratified_split(df.repartition(3, "v"), frac, "k", by).where("split = 'dev'")
            assert sorted(str(r) for r in again.collect()) == held and marked.count() == 500


def test_ranges_from_a_sketch_of_the_order(spark):
    """Sparse, negative, decimal and null orders; more ranges than values; a fill carried over empty ranges."""
    order = [-5.5, 0.0, 1e-9, 3.0, 1e12, 1e12 + 1, 2e15] + [float(10 ** k) for k in range(1, 9)]
    for ranges in (1, 2, 5, 64):
        df = spark.createDataFrame([(x, x if i % 4 == 0 else None) for i, x in enumerate(sorted(order))], "o double, v double").repartition(4)
        filled = {r.o: r.v for r in prepare.forward_fill(df, ["v"], "o", ranges).collect()}
        want, last = {}, None
        for i, x in enumerate(sorted(order)):
            last = x if i % 4 == 0 else last
            want[x] = last
        assert filled == want
        numbered = ordering.dense_row_number(df, "o", ranges=ranges).collect()
        assert [r.row_number for r in sorted(numbered)] == list(range(1, len(order) + 1))
    plan = prepare.forward_fill(spark.range(100).selectExpr("id", "id AS v"), ["v"], "id", 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(__range") <= 2 and "Scan parquet" not in plan


def test_missing_predictions_are_wrong(spark):
    df = spark.createDataFrame([("a", "a"), ("a", None), ("b", "a"), (None, "a")], "label string, prediction string")
    assert metrics.accuracy(df).first()[0] == pytest.approx(1 / 3)
