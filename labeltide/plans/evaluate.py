"""End-to-end plans composed from the operators.

``prepare_corpus``  clean -> drop NULL rows -> (optional) text dedup
``score_and_evaluate``  dictionary -> encode -> score -> decode -> join gold
                        -> one confusion aggregate -> report

All lazy up to the actions the caller runs; the only Python boundary is the
scorer's ``mapInArrow``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_text
from ..operators import blocks, encode, labels, metrics, prepare, score
from ..session import stored


def prepare_corpus(df: DataFrame, text_col: str = "text", order_col: str = "row_ord",
                   dedup_text: bool = False, drop_nulls: str | bool = "text") -> DataFrame:
    """Clean the text column in one projection, with the optional row filters.

    ``drop_nulls``: ``"text"`` drops rows without text, ``"any"`` drops rows
    with a NULL in any column (so unlabelled rows go too, as the original
    cleaner's ``dropna`` did), ``"none"``/``False`` keeps every row.
    """
    # Cleaning maps NULL to NULL and text to text, so the NULL filter runs
    # before it and stays on the raw columns.
    if drop_nulls in (True, "text"):
        out = prepare.drop_null_rows(df, [text_col])
    elif drop_nulls == "any":
        out = prepare.drop_null_rows(df)
    elif drop_nulls in (False, None, "none"):
        out = df
    else:
        raise ValueError(f"drop_nulls must be 'text', 'any' or 'none', not {drop_nulls!r}")
    out = out.withColumn(text_col, clean_text(F.col(text_col)))
    if dedup_text:
        out = prepare.dedup_text(out, text_col, order_col)
    return out


def class_distribution(docs: DataFrame, gold: DataFrame, key: str, label_expr,
                       text_col: str = "text") -> DataFrame:
    """Class counts over cleaned, text-deduplicated rows joined to gold labels."""
    cleaned = docs.select(key, clean_text(F.col(text_col)).alias(text_col))
    joined = prepare.first_orders(cleaned, text_col, key).join(gold, key, "inner")
    return prepare.value_counts(joined.select(label_expr.alias("label")), "label", "n")


def fit_and_score(train: DataFrame, test: DataFrame, id_col: str = "id", text_col: str = "text", label_col: str = "label",
                  order_col: str = "row_ord", vocab_size: int | None = None, max_len: int | None = None):
    """Fit token weights on ``train`` and score ``test``: (scored, dictionary, cleaned training rows).

    ``scored`` has ``id_col``, logits and ``pred_id``, one row per test row.
    """
    return fit_and_score_tasks(train, test, [label_col], id_col, text_col, order_col, vocab_size, max_len)[0]


def fit_and_score_tasks(train: DataFrame, test: DataFrame, label_cols: Sequence[str], id_col: str = "id", text_col: str = "text",
                        order_col: str = "row_ord", vocab_size: int | None = None, max_len: int | None = None) -> list[tuple]:
    """:func:`fit_and_score` for every label column of ``train``.

    Both sides are cleaned once.  Tasks that label the same rows have the same vocabulary,
    so their texts are counted, encoded and looked up once; others are fitted one by one.
    """
    labelled = [F.col(c).isNotNull() for c in label_cols]
    rows = stored(prepare_corpus(train, text_col, order_col).where(reduce(or_, labelled)), "train")
    asked = prepare_corpus(test, text_col, order_col, drop_nulls="none").select(id_col, text_col)
    if len(label_cols) == 1 or rows.where(~reduce(and_, labelled)).isEmpty():
        return _fit_and_score(rows, asked, label_cols, id_col, text_col, order_col, vocab_size, max_len)
    asked = stored(asked, "asked")
    return [_fit_and_score(rows.where(has), asked, [c], id_col, text_col, order_col, vocab_size, max_len)[0] for c, has in zip(label_cols, labelled)]


def _fit_and_score(train: DataFrame, test: DataFrame, label_cols: Sequence[str], id_col: str, text_col: str,
                   order_col: str, vocab_size: int | None, max_len: int | None) -> list[tuple]:
    """Of cleaned rows that all have a label in each of ``label_cols``."""
    dictionaries = [stored(labels.label_dictionary(train, c, order_col), "dictionary") for c in label_cols]
    n_classes = {f"label_id_{k}": d.count() for k, d in enumerate(dictionaries)}
    vocab = stored(encode.build_vocabulary(train, text_col, vocab_size), "vocabulary")
    numbered = train.select(text_col, *label_cols)
    for c, out, d in zip(label_cols, n_classes, dictionaries):
        numbered = labels.encode_labels(numbered, d, c, out, as_string=False)
    train_e = stored(encode.encode_tokens(numbered.select(text_col, *n_classes), vocab, text_col), "encoded")
    test_e = encode.encode_tokens(test, vocab, text_col, keep_block=True)
    if max_len:
        train_e = encode.truncate_tokens(train_e, max_len)
        test_e = encode.truncate_tokens(test_e, max_len)
    weights = score.train_token_weights_of(train_e, "input_ids", n_classes, vocab.count() + encode.FIRST_TOKEN_ID)
    scored = stored(score.score_by_weights(blocks.blocked(test_e, "test"), weights, "input_ids", "__logits", "__pred"), "scored")
    found, first = [], 1
    for n, d in zip(n_classes.values(), dictionaries):
        own = scored.select(id_col, F.slice("__logits", first, n).alias("logits"))
        found.append((own.withColumn("pred_id", labels.argmax("logits").cast("string")), d, train))
        first += n
    return found


def score_and_evaluate(train: DataFrame, test: DataFrame, gold: DataFrame,
                       id_col: str = "id", text_col: str = "text", label_col: str = "label",
                       order_col: str = "row_ord", vocab_size: int | None = None,
                       max_len: int | None = None, fallback: str = "0", given: Column | None = None):
    """Fit a token scorer on ``train`` and evaluate it on ``test`` against ``gold``.

    Returns ``(predictions, report, unmatched)``; predictions carry the decoded
    label name, pairing with gold is by id, never by position.  ``fallback``
    is the id given to empty or malformed predictions: ``"0"`` as the scoring
    scripts do, or ``"majority"`` for the most frequent training label.  ``given``,
    an expression over the scored columns, replaces ``pred_id``: predictions as
    another model wrote them, which may be empty or malformed.
    """
    fitted = fit_and_score(train, test, id_col, text_col, label_col, order_col, vocab_size, max_len)
    return evaluated(*fitted, gold, id_col, label_col, label_col, fallback, given)


def evaluated(scored: DataFrame, dictionary: DataFrame, train_c: DataFrame, gold: DataFrame, id_col: str = "id", label_col: str = "label",
              gold_col: str = "label", fallback: str = "0", given: Column | None = None):
    """What :func:`score_and_evaluate` returns, of one result of the fit; the training rows have ``label_col``, the gold rows ``gold_col``."""
    if given is not None:
        scored = scored.withColumn("pred_id", given)
    n_classes = dictionary.count()
    decoded = labels.decode_labels(scored, dictionary, "pred_id", "prediction")
    gold_ids = labels.encode_labels(gold, dictionary, gold_col, "gold_id")
    paired = prepare.align_by_id(decoded, gold_ids.select(id_col, "gold_id"), id_col)
    if fallback == "majority":
        fallback = labels.majority_fallback(
            labels.encode_labels(train_c, dictionary, label_col, "train_id"), "train_id") or "0"
    report = metrics.classification_report(paired, "gold_id", "pred_id", fallback=fallback, n_classes=n_classes)
    missing = prepare.unmatched(decoded, gold, id_col)
    return decoded, report, missing
