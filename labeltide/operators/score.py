"""Distributed scoring.

* L8 ``score_batches``: ``mapInArrow`` over Arrow batches.  The scorer is a
  picklable factory; it is called once per task (the "model load"), then
  applied to each batch.  Rows keep their id, so order never matters.
* L8 with a model of any size: ``train_token_weights`` fits multinomial naive
  Bayes by one aggregate over exploded token ids and leaves the log weights a
  table; ``score_by_weights`` brings each block of rows the weights of its own
  tokens.  Nothing of the size of the vocabulary reaches the driver or a task.
* L9/L10: a Spark ML pipeline (tokenizer, hashing TF, IDF, logistic
  regression) that trains and scores on the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stored
from .blocks import replace_entries
from .labels import argmax

ScorerFactory = Callable[[], Callable[["pyarrow.RecordBatch"], np.ndarray]]


# --------------------------------------------------------------------- L8
def score_batches(df: DataFrame, factory: ScorerFactory, id_col: str,
                  input_cols: Sequence[str], logits_col: str = "logits",
                  pred_col: str = "prediction") -> DataFrame:
    """Score rows in Arrow batches; adds ``logits`` ARRAY<DOUBLE> and ``prediction``.

    ``mapInArrow``: each task calls ``factory()`` once (the model load), then
    hands every ``pyarrow.RecordBatch`` of ``id_col`` + ``input_cols`` to the
    scorer, which returns an ``(rows, classes)`` array.  Only those columns
    cross into Python; the prediction (argmax, first index on ties) is
    computed JVM-side afterwards.
    """
    import pyarrow as pa

    cols = [id_col, *[c for c in input_cols if c != id_col]]
    id_type = df.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, id_type),
                           T.StructField(logits_col, T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = factory()
        for batch in batches:
            logits = np.asarray(scorer(batch), dtype=np.float64).reshape(batch.num_rows, -1)
            k = logits.shape[1]
            offsets = pa.array(np.arange(0, (batch.num_rows + 1) * k, k, dtype=np.int32))
            values = pa.ListArray.from_arrays(offsets, pa.array(logits.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), values],
                                             names=[id_col, logits_col])

    scored = df.select(*cols).mapInArrow(run, schema)
    return scored.withColumn(pred_col, argmax(logits_col).cast("string"))


@dataclass
class TokenWeights:
    """Log weights per token (``table``: token_id, weights), those of a token that no training row holds, and per class."""

    table: DataFrame
    unseen: list[float]
    bias: list[float]


def train_token_weights(encoded: DataFrame, ids_col: str, label_col: str, n_classes: int,
                        vocab_size: int, alpha: float = 1.0) -> TokenWeights:
    """Multinomial naive Bayes over token ids, counted by Spark.

    Ids from 0 to ``vocab_size`` - 1 and labels from 0 to ``n_classes`` - 1 count.  The
    weights stay a stored table; only totals per class reach the driver.
    """
    return train_token_weights_of(encoded, ids_col, {label_col: n_classes}, vocab_size, alpha)


def train_token_weights_of(encoded: DataFrame, ids_col: str, n_classes: dict[str, int],
                           vocab_size: int, alpha: float = 1.0) -> TokenWeights:
    """:func:`train_token_weights` for several label columns in one pass: the classes of all columns, one column's after the other's."""
    labels = {c: F.col(c).cast("int").alias(f"c_{k}") for k, c in enumerate(n_classes)}
    counted = [F.col(f"c_{k}").between(0, n - 1) for k, n in enumerate(n_classes.values())]
    rows = encoded.select(*labels.values(), ids_col).where(reduce(or_, counted))
    each = rows.select(*[f"c_{k}" for k in range(len(labels))], F.explode(ids_col).alias("t")).where(F.col("t") < vocab_size)
    classes = [(k, c) for k, n in enumerate(n_classes.values()) for c in range(n)]
    per_class = [F.count_if(F.col(f"c_{k}") == c).alias(f"n_{k}_{c}") for k, c in classes]
    counts = stored(each.groupBy("t").agg(*per_class), "token-counts")
    names = [f"n_{k}_{c}" for k, c in classes]
    total = counts.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    prior = rows.agg(*per_class).first()
    sums = [total[n] + alpha * vocab_size for n in names]
    weights = F.array(*[F.log((F.col(n) + alpha) / F.lit(float(s))) for n, s in zip(names, sums)])
    labelled = [sum(prior[f"n_{k}_{c}"] for c in range(n)) + alpha * n for k, n in enumerate(n_classes.values())]
    return TokenWeights(counts.select(F.col("t").cast("int").alias("token_id"), weights.alias("weights")), [float(np.log(alpha / s)) for s in sums],
                        [float(np.log((prior[n] + alpha) / labelled[k])) for n, (k, _) in zip(names, classes)])


def score_by_weights(rows: DataFrame, weights: TokenWeights, ids_col: str, logits_col: str = "logits",
                     pred_col: str = "prediction") -> DataFrame:
    """``rows`` (from ``blocks.blocked``) with ``ids_col`` replaced by ``logits`` and ``prediction`` (as ``score_batches`` gives them)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    bias, unseen = np.array(weights.bias), np.array(weights.unseen)

    def logits(lists: pa.ListArray, known: pa.Table) -> pa.Array:
        own = known.column("weights").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(bias))
        table = np.vstack((own, unseen))
        place = pc.fill_null(pc.index_in(lists.flatten(), value_set=known.column("token_id").combine_chunks()), len(own)).to_numpy()
        starts = lists.offsets.to_numpy()
        starts = starts - starts[0]
        sums = np.zeros((len(lists), len(bias)))
        filled = np.flatnonzero(np.diff(starts))
        if len(filled):
            sums[filled] = np.add.reduceat(table[place], starts[filled], axis=0)
        flat = pa.array((sums + bias).ravel())
        return pa.ListArray.from_arrays(pa.array((np.arange(len(lists) + 1) * len(bias)).astype(np.int32)), flat)

    scored = replace_entries(rows, ids_col, weights.table, "token_id", logits, T.StructField(logits_col, T.ArrayType(T.DoubleType())))
    return scored.withColumn(pred_col, argmax(logits_col).cast("string"))


# --------------------------------------------------------------------- L9 / L10
def train_text_classifier(train: DataFrame, text_col: str, label_col: str,
                          num_features: int = 1 << 18, max_iter: int = 50,
                          reg_param: float = 0.0, tolerance: float = 1e-6):
    """Tokenizer -> hashing TF -> IDF -> logistic regression, fitted on the cluster.

    The hashed term frequencies are stored once as Parquet: the IDF fit, the
    regression's summary pass and every optimiser iteration read them instead
    of re-tokenising the texts, and a lost executor costs its running tasks.  Labels are class numbers (see
    ``train_named_classifier`` for names).  Returns a ``PipelineModel``.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, IDF, RegexTokenizer

    tokenizer = RegexTokenizer(inputCol=text_col, outputCol="__tokens", pattern=r"\s+",
                               toLowercase=False)
    hashing = HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=num_features)
    label = F.col(label_col).try_cast("double")
    data = train.select(text_col, label.alias("__label"), F.col(label_col).alias("__raw_label")).where(
        F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    bad = data.where(F.col("__label").isNull()).select(F.col("__raw_label").cast("string")).first()
    if bad is not None:
        raise ValueError(f"label {bad[0]!r} is no number; number the labels first (label_dictionary, encode_labels)")
    tf = stored(hashing.transform(tokenizer.transform(data)).select("__tf", "__label"), "term-frequencies")
    idf = IDF(inputCol="__tf", outputCol="__features").fit(tf)
    # The scaling stays a projection over the one stored table.
    feats = idf.transform(tf).select("__features", "__label")
    lr = LogisticRegression(featuresCol="__features", labelCol="__label",
                            maxIter=max_iter, regParam=reg_param, family="auto",
                            tol=tolerance,
                            predictionCol="__pred", probabilityCol="__prob",
                            rawPredictionCol="__raw").fit(feats)
    return PipelineModel(stages=[tokenizer, hashing, idf, lr])


def fit_gradient(model, train: DataFrame, text_col: str, label_col: str, reg_param: float) -> DataFrame:
    """One row: rows n, the largest entry of the loss gradient at the model's coefficients, and that of its intercept.

    The loss is the mean logistic loss of a two-class model plus ``reg_param`` / 2 times the
    squared coefficients, in units of each feature's standard deviation, as the fit has it.
    Sums of features times residuals, positive and negative ones apart, come from one
    aggregate; the result is as long as the coefficients.
    """
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = model.transform(train.select(text_col, F.col(label_col).cast("double").alias("__y")))
    rows = rows.select("__features", (F.get(vector_to_array("__prob"), 1) - F.col("__y")).alias("__r"))
    sums = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("__r").alias("r"), Summarizer.std(F.col("__features")).alias("std"),
                    Summarizer.sum(F.col("__features"), F.greatest("__r", F.lit(0.0))).alias("up"),
                    Summarizer.sum(F.col("__features"), F.greatest(-F.col("__r"), F.lit(0.0))).alias("down")).first()
    std, fitted = sums["std"].toArray(), model.stages[-1].coefficients.toArray()
    used = std > 0
    gradient = (sums["up"].toArray() - sums["down"].toArray())[used] / std[used] / sums["n"] + reg_param * (fitted * std)[used]
    return train.sparkSession.createDataFrame([(sums["n"], float(np.abs(gradient).max(initial=0.0)), abs(sums["r"]) / sums["n"])],
                                              "n long, gradient double, intercept_gradient double")


def train_named_classifier(train: DataFrame, text_col: str, label_col: str, order_col: str, **options):
    """L9 for labels of any kind: (model, dictionary), the labels numbered by L1."""
    from .labels import encode_labels, label_dictionary

    dictionary = stored(label_dictionary(train, label_col, order_col), "dictionary")
    numbered = encode_labels(train, dictionary, label_col, "__id", as_string=False)
    return train_text_classifier(numbered.select(text_col, "__id"), text_col, "__id", **options), dictionary


def apply_classifier(model, df: DataFrame, text_col: str, pred_col: str = "prediction",
                     prob_col: str = "probability") -> DataFrame:
    """Prediction (class index as string) and the probability vector as an array."""
    from pyspark.ml.functions import vector_to_array

    src = df.withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    out = model.transform(src)
    keep = [c for c in df.columns if c not in (pred_col, prob_col)]
    return out.select(*keep,
                      F.col("__pred").cast("int").cast("string").alias(pred_col),
                      vector_to_array("__prob").alias(prob_col))
