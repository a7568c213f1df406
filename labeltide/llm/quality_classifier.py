"""Operator 1: a quality classifier on n-gram indicators scaled by naive-Bayes log-count ratios.

Features of a text are the distinct hashed word 1-grams and 2-grams and
character 4-grams of the whole text.  Over all training rows, one sum per
feature and class gives the log-count ratio r.  A linear hinge-loss model on
the indicators scaled by r is then fitted by dual coordinate descent, on 
about ``fit_rows`` training rows chosen by hash, and interpolated with the mean
weight.  The margins of a tenth of these rows, which the descent does not see,
give the logistic curve that turns a margin into a score.

The model is ``2 ** bits`` weights, whatever the size of the corpus, so its
broadcast is bounded.  Scoring reads each text once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltide.llm.common import Stage
from labeltide.llm.wordhash import WordHasher, mix, text_chunks

BITS = 18
FIT_ROWS = 4000


def _features(hasher: WordHasher, column: pa.Array, bits: int) -> Iterator[np.ndarray]:
    """Each text's distinct feature numbers, in order."""
    mask = np.uint64((1 << bits) - 1)
    seen = np.zeros(1 << bits, dtype=bool)
    for _, _, data, offsets in text_chunks(column):
        words, _, _, bounds = hasher.words(data, offsets)
        pairs = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) & mask if len(words) else words
        single = (mix(words + np.uint64(77)) & mask).astype(np.int64)
        pairs = pairs.astype(np.int64)
        value = hasher.value[data]
        grams = value.copy()
        for k in range(1, 4):
            grams[:-k] += value[k:] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
        grams = (mix(grams) & mask).astype(np.int64)
        for i in range(len(offsets) - 1):
            a, b = bounds[i], bounds[i + 1]
            found = np.concatenate((single[a:b], pairs[a:max(a, b - 1)], grams[offsets[i]:max(offsets[i], offsets[i + 1] - 3)]))
            if len(found) > 1 << (bits - 4):
                seen[found] = True
                yield (out := np.flatnonzero(seen))
                seen[out] = False
            else:
                found.sort()
                new = np.ones(len(found), dtype=bool)
                new[1:] = found[1:] != found[:-1]
                yield found[new]


def _counter(bits: int):
    """Rows (text, label) to the counts of each feature in class 0 and 1, one row per feature and task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts = WordHasher(), np.zeros((2, 1 << bits), dtype=np.int64)
        for batch in batches:
            for label, found in zip(batch.column(1).to_pylist(), _features(hasher, batch.column(0), bits)):
                counts[label, found] += 1
        at = np.flatnonzero(counts.any(axis=0))
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[0, at]), pa.array(counts[1, at])], names=["feature", "n0", "n1"])
    return run


def _indexer(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            found = [x.astype("<i4").tobytes() for x in _features(hasher, batch.column(0), bits)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.binary())], names=["label", "place", "features"])
    return run


def dual_coordinate_descent(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float = 1.0,
                            epochs: int = 12, tolerance: float = 1e-3, seed: int = 1) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss model on indicator rows scaled by ``scale``.

    Each step solves one dual variable exactly, box-constrained to [0, cost]; rows are
    visited in a new random order every epoch, until no projected gradient exceeds ``tolerance``.
    """
    weights, alpha = np.zeros(len(scale)), np.zeros(len(rows))
    values = [scale[x] for x in rows]
    norms = np.array([v @ v for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            if not norms[i]:
                continue
            gradient = labels[i] * (weights[rows[i]] @ values[i]) - 1
            projected = min(gradient, 0) if alpha[i] == 0 else max(gradient, 0) if alpha[i] == cost else gradient
            worst = max(worst, abs(projected))
            if projected:
                new = min(max(alpha[i] - gradient / norms[i], 0.0), cost)
                weights[rows[i]] += (new - alpha[i]) * labels[i] * values[i]
                alpha[i] = new
        if worst < tolerance:
            break
    return weights


def platt_curve(margins: np.ndarray, labels: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """(a, b) of 1 / (1 + exp(-(a * margin + b))) by Newton steps on smoothed targets."""
    good = labels > 0
    n1, n0 = good.sum(), (~good).sum()
    target = np.where(good, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    x = np.stack([margins, np.ones(len(margins))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        gradient = x @ (p - target) + 1e-3 * np.array([a, b])
        hessian = (x * (p * (1 - p) + 1e-9)) @ x.T + 1e-3 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return max(a, 1e-6), b


def _fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, blend: float, cost: float) -> tuple[np.ndarray, float, float]:
    """Weights per feature (ratio included) and the score curve."""
    held = np.arange(len(rows)) % 10 == 9
    fit = np.flatnonzero(~held)
    spread = float(np.mean([(ratio[rows[i]] ** 2).sum() for i in fit])) or 1.0
    scale = ratio / np.sqrt(spread)
    weights = dual_coordinate_descent([rows[i] for i in fit], labels[fit], scale, cost)
    used = weights != 0
    mean = np.abs(weights[used]).mean() if used.any() else 0.0
    blended = ((1 - blend) * mean + blend * weights) * scale
    margins = np.array([blended[rows[i]].sum() for i in np.flatnonzero(held)])
    return blended, *platt_curve(margins, labels[held])


def _scorer(model, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        weights, a, b = model.value
        for batch in batches:
            margins = np.array([weights[x].sum() for x in _features(hasher, batch.column(1), bits)], dtype=np.float64)
            scores = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["id", "score"])
    return run


def train(examples: DataFrame, bits: int = BITS, fit_rows: int = FIT_ROWS, smoothing: float = 1.0, blend: float = 0.75,
          cost: float = 10.0, seed: int = 1) -> tuple[np.ndarray, float, float]:
    """The model from ``examples`` (text, label, place); ``place``, a hash, picks about ``fit_rows`` of them to be fitted.

    The counts behind the log-count ratios cover all examples.  Without examples of both
    classes the model is constant: the share of class 1, smoothed.
    """
    counts = (examples.select("text", "label").mapInArrow(_counter(bits), "feature long, n0 long, n1 long")
              .groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toArrow())
    n = np.full((2, 1 << bits), smoothing)
    for k, c in enumerate(("n0", "n1")):
        n[k, counts.column("feature").to_numpy()] += counts.column(c).to_numpy()
    ratio = np.log(n[1] / n[1].sum()) - np.log(n[0] / n[0].sum())
    share = min(1.0, fit_rows / max(1, examples.count()))
    picked = examples.where(F.pmod("place", F.lit(1 << 30)) < int(share * (1 << 30)))
    picked = picked.select("text", "label", "place").mapInArrow(_indexer(bits), "label int, place long, features binary").toArrow()
    rows = [np.frombuffer(x, dtype="<i4") for x in picked.column("features").to_pylist()]
    order = np.argsort(picked.column("place").to_numpy(), kind="stable")
    rows = [rows[i] for i in order]
    labels = np.where(picked.column("label").to_numpy()[order] == 1, 1.0, -1.0) if len(rows) else np.zeros(0)
    good = int((labels > 0).sum())
    if good in (0, len(rows)) or len(rows) < 20:
        share = (good + 1) / (len(rows) + 2)
        return np.zeros(1 << bits), 1.0, float(np.log(share / (1 - share)))
    return _fit(rows, labels, ratio, blend, cost)


def score_quality(docs: DataFrame, labels: DataFrame, train_on: Column, id_col: str = "doc_id", text_col: str = "text",
                  label_col: str = "quality", seed: int = 1, **options) -> DataFrame:
    """Per row: ``id_col``, score (0 to 1), predicted (1 from 0.5).

    ``train_on``: which ids may be learned from.  A null text is scored as empty, by the
    curve's intercept.  Labels other than 0 and 1 are ignored; an id labelled twice gives
    an example per label; rows that share an id are each scored.  Null ids are scored, never
    learned from.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col("doc_id").alias("_id"), F.col(label_col).cast("int").alias("label"))
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    # Labels grow with the corpus, so they are never broadcast.
    examples = (own.where(train_on).join(known.hint("merge"), "_id")
                .select("text", "label", F.xxhash64("_id", "label", F.lit(seed)).alias("place")))
    stage = Stage(spark, "quality")
    examples = stage.put(examples, "examples")
    bits = options.get("bits", BITS)
    model = spark.sparkContext.broadcast(train(examples, seed=seed, **options))
    stage.drop("examples")
    kind = docs.schema[id_col].dataType.simpleString()
    scored = own.mapInArrow(_scorer(model, bits), f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
