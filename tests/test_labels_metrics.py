import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labeltide.operators import encode, labels, metrics


def _f1s(truth, pred):
    classes = sorted(set(truth) | set(pred))
    out = {}
    for c in classes:
        tp = sum(1 for t, p in zip(truth, pred) if t == c and p == c)
        s = sum(1 for t in truth if t == c)
        q = sum(1 for p in pred if p == c)
        out[c] = (2 * tp / (s + q) if s + q else 0.0, s)
    return out


def test_metric_edge_case(spark):
    # truths 0..3; predictions '' and '12' are repaired to '0'; '9' never true; '3' never predicted
    truth = ["0", "1", "2", "3", "1", "2"]
    pred = ["0", "1", "2", "", "12", "9"]
    df = spark.createDataFrame(list(zip(truth, pred)), "label string, prediction string")
    rep = metrics.classification_report(df).first()
    fixed = ["0" if len(p) != 1 else p for p in pred]
    f = _f1s(truth, fixed)
    assert rep.classes == sorted(f)
    assert rep.f1_per_class == pytest.approx([f[c][0] for c in sorted(f)])
    assert rep.f1_macro == pytest.approx(np.mean([v[0] for v in f.values()]))
    w = sum(v[0] * v[1] for v in f.values()) / len(truth)
    assert rep.f1_weighted == pytest.approx(w)
    acc = sum(t == p for t, p in zip(truth, fixed)) / len(truth)
    assert rep.f1_micro == pytest.approx(acc) and rep.accuracy == pytest.approx(acc)
    assert f["9"][0] == 0.0 and f["3"][0] == 0.0


def test_random_parity_and_mcc(spark):
    rng = random.Random(3)
    truth = [rng.choice("0123") for _ in range(2000)]
    pred = [rng.choice(["0", "1", "2", "3", "", "45"]) for _ in range(2000)]
    df = spark.createDataFrame(list(zip(truth, pred)), "label string, prediction string")
    rep = metrics.classification_report(df).first()
    fixed = ["0" if len(p) != 1 else p for p in pred]
    f = _f1s(truth, fixed)
    assert rep.f1_macro == pytest.approx(np.mean([v[0] for v in f.values()]), abs=1e-12)
    # multi-class MCC from the confusion matrix
    cl = sorted(set(truth) | set(fixed))
    C = np.zeros((len(cl), len(cl)))
    for t, p in zip(truth, fixed):
        C[cl.index(t), cl.index(p)] += 1
    t_k, p_k, c, s = C.sum(1), C.sum(0), np.trace(C), C.sum()
    mcc = (c * s - t_k @ p_k) / math.sqrt((s * s - p_k @ p_k) * (s * s - t_k @ t_k))
    assert rep.mcc == pytest.approx(mcc)


def test_confusion_restricted_and_cells(spark):
    df = spark.createDataFrame([("1", "1"), ("1", "0"), ("0", "0"), ("0", "0"), ("2", "1")],
                               "label string, prediction string")
    conf = metrics.confusion(df)
    grid = [(r.label, r.prediction, r.n) for r in
            metrics.confusion_restricted(conf, ["1", "0"]).orderBy("row", "col").collect()]
    assert grid == [("1", "1", 1), ("1", "0", 1), ("0", "1", 0), ("0", "0", 2)]
    cells = metrics.binary_cells(conf, "1", "0").first()
    assert (cells.tn, cells.fp, cells.fn, cells.tp) == (1, 1, 0, 2)
    wide = metrics.confusion_wide(conf, ["0", "1"]).collect()
    assert [tuple(r) for r in wide] == [("0", 2, 0), ("1", 1, 1), ("2", 0, 1)]


def test_dictionary_encode_decode_roundtrip(spark):
    train = spark.createDataFrame([(5, "NOT"), (1, "HOF"), (9, "NOT"), (3, None), (7, "X")],
                                  "o long, label string")
    d = labels.label_dictionary(train, "label", "o")
    assert sorted((r.label, r.label_id) for r in d.collect()) == [("HOF", 0), ("NOT", 1), ("X", 2)]
    rows = spark.createDataFrame([("a", "NOT"), ("b", "HOF"), ("c", "NEW")], "id string, label string")
    enc = labels.encode_labels(rows, d, "label")
    assert sorted((r.id, r.label) for r in enc.collect()) == [("a", "1"), ("b", "0"), ("c", "NEW")]
    dec = labels.decode_labels(enc, d, "label", "back").orderBy("id").collect()
    assert [r.back for r in dec] == ["NOT", "HOF", ""]
    as_int = labels.encode_labels(rows, d, "label", "lid", as_string=False).orderBy("id").collect()
    assert [r.lid for r in as_int] == [1, 0, None]
    assert labels.majority_fallback(train, "label") == "NOT"


def test_argmax_and_repair(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0],), ([float("nan"), 1.0],), ([-1.0],)],
                               "v array<double>")
    got = [r.a for r in df.select(labels.argmax("v").alias("a")).collect()]
    assert got == [int(np.argmax([1, 3, 3])), 0, 0]
    p = spark.createDataFrame([("",), ("12",), ("3",), (None,)], "p string")
    assert [r.q for r in p.select(labels.repair_predictions("p").alias("q")).collect()] == ["0", "0", "3", "0"]
    assert labels.count_repairs(p, "p").first().repaired == 3


def test_mean_loss_and_best_epoch(spark):
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(70, 4))
    y = rng.integers(0, 4, size=70)
    df = spark.createDataFrame([(i, logits[i].tolist(), int(y[i])) for i in range(70)],
                               "o long, l array<double>, y int")
    b = encode.assign_batches(df, 32, "o", ranges=8)
    got = metrics.mean_loss(b, "l", "y", "batch").first()
    ce = np.log(np.exp(logits).sum(1)) - logits[np.arange(70), y]
    want = np.mean([ce[i:i + 32].mean() for i in range(0, 70, 32)])
    assert got.mean_loss == pytest.approx(want) and got.batches == 3
    hist = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.3), ("r", 3, 0.3), ("s", 1, None), ("s", 2, 0.9)],
                                 "run string, epoch int, val_loss double")
    best = {r.run: (r.best_epoch, r.best_loss) for r in metrics.best_epoch(hist).collect()}
    assert best == {"r": (2, 0.3), "s": (2, 0.9)}


def test_published_macro_is_mean_of_pair():
    assert (0.84530744 + 0.76499508) / 2 == pytest.approx(0.8051512634724252, abs=1e-8)


def test_dictionary_large_path(spark):
    train = spark.createDataFrame([(i, f"L{i % 7}") for i in range(50, 0, -1)], "o long, label string")
    d = labels.label_dictionary(train, "label", "o")
    got = sorted((r.label_id, r.label) for r in d.collect())
    assert [i for i, _ in got] == list(range(7))
    firsts = sorted(((min(i for i in range(1, 51) if i % 7 == k), f"L{k}") for k in range(7)))
    assert [lab for _, lab in got] == [lab for _, lab in firsts]


def test_unlabelled_rows_are_left_out(spark):
    df = spark.createDataFrame([("a", "a"), ("b", "b"), (None, "a"), (None, None)], "label string, prediction string")
    r = metrics.classification_report(df, repair=False).first()
    assert r.f1_macro == 1.0 and r.accuracy == 1.0 and r.n == 2 and r.n_classes == 2
    assert metrics.unlabelled(df).first().unlabelled == 2


def test_report_of_twelve_classes(spark):
    rows = [(str(k), str(k)) for k in range(12)] * 3
    df = spark.createDataFrame(rows, "label string, prediction string")
    r = metrics.classification_report(df, n_classes=12).first()
    assert r.f1_macro == 1.0 and r.accuracy == 1.0
    bad = spark.createDataFrame([("0", p) for p in ("12", "x", "", None, "01", "-1", "99999999999")], "label string, prediction string")
    assert {x.prediction for x in metrics.confusion(bad, repair=True, n_classes=12).collect()} == {"0"}
