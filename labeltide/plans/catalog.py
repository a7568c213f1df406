"""Registered queries over the driver tables, one or more per operator.

``QUERIES[name](spark, sf_dir) -> DataFrame``.  Every query reads whole
tables (or data Spark derives from them); no row caps or id subsets.  The
matching DuckDB statements live in ``plans/oracle.py``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import augment, blocks, encode, labels, layout, metrics, prepare, score
from ..session import scratch_path, stored
from ..sinks import writers
from ..streaming import files as stream_files
from ..sources import delimited, registry
from . import evaluate

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters shared with the oracle statements.
HOLDOUT_FRAC = 0.1
STRATIFIED_FRAC = 0.2
SHUFFLE_SEED = 42
MAX_TOKENS = 32
BATCH_SIZE = 32
DOC_BATCH = 16
LOGIT_CLASSES = 10


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def texts(spark: SparkSession, sf: str, name: str, *cols: str) -> DataFrame:
    """Columns of a table of texts, for work per row: an input of one split is dealt to all cores."""
    return layout.spread_one_split(table(spark, sf, name).select(*cols))


def _docs_clean(spark, sf, *more: str) -> DataFrame:
    return texts(spark, sf, "documents", "doc_id", "text", *more).withColumn("text", X.clean_text(F.col("text")))


def _docs_clean_shared(spark, sf) -> DataFrame:
    """Cleaned documents for queries that read them twice.

    The regex chain costs far more per byte than writing its result, so the
    cleaned text is stored once (Parquet) instead of being cleaned again.
    """
    return stored(_docs_clean(spark, sf), "clean")


def _toxic_label(col: str = "toxic"):
    return F.when(F.col(col) == 1, F.lit("HOF")).otherwise(F.lit("NOT"))


# ------------------------------------------------------------- flagship
@query("class_distribution")
def q_class_distribution(spark, sf):
    """documents -> clean -> text dedup -> join labels -> class counts."""
    return evaluate.class_distribution(
        texts(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "labels"), "doc_id", _toxic_label())


# ------------------------------------------------------------- X1-X17
@query("clean_text")
def q_clean_text(spark, sf):
    return _docs_clean(spark, sf)


def _ip_text():
    # Addresses built from the id bits (valid octets) plus one invalid octet.
    d = F.col("doc_id")
    ip = F.concat_ws(".", d.bitwiseAND(255).cast("string"),
                     F.shiftright(d, 8).bitwiseAND(255).cast("string"),
                     F.lit("0"), F.lit("1"))
    return F.concat(F.lit("ip "), ip, F.lit(" and 999."), ip, F.lit(". "), F.col("text"))


def _url_text():
    return F.concat(F.lit("see "), F.col("url"), F.lit(" www."), F.col("page_id").cast("string"),
                    F.lit(".org awwwesome http"))


def _step_query(name: str, step, source: str = "documents"):
    def run(spark, sf):
        if source == "ip":
            df = texts(spark, sf, "documents", "doc_id", "text").select("doc_id", _ip_text().alias("text"))
        elif source == "url":
            df = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"),
                                                  _url_text().alias("text"))
        else:
            df = texts(spark, sf, "documents", "doc_id", "text")
        return df.select("doc_id", step(F.col("text")).alias("text"))
    QUERIES[name] = run


_step_query("clean_emails", X.remove_emails)
_step_query("clean_ipv4", X.remove_ipv4, "ip")
_step_query("clean_http", X.remove_http, "url")
_step_query("clean_www", X.remove_www, "url")
_step_query("clean_special", X.remove_special)
_step_query("clean_symbols", X.remove_symbols)
_step_query("clean_open_bracket", X.remove_open_bracket)
_step_query("clean_close_bracket", X.remove_close_bracket)
_step_query("clean_newlines", X.newline_to_space)
_step_query("clean_tabs", X.tab_to_space)
_step_query("clean_spaces", X.collapse_spaces)
_step_query("clean_lower", X.to_lower)
_step_query("clean_strip", X.strip_whitespace)
_step_query("clean_digits", X.remove_digits)


@query("add_prefix")
def q_add_prefix(spark, sf):
    return _docs_clean(spark, sf).select("doc_id", X.add_prefix(F.col("text")).alias("text"))


@query("to_string")
def q_to_string(spark, sf):
    return table(spark, sf, "labels").select(
        "doc_id", X.to_string(F.col("quality")).alias("quality"),
        X.to_string(F.col("toxic")).alias("toxic"))


# ------------------------------------------------------------- D1-D18
def _docs_with_labels(spark, sf) -> DataFrame:
    return (table(spark, sf, "documents").select("doc_id", "lang")
            .join(table(spark, sf, "labels"), "doc_id", "left"))


@query("forward_fill")
def q_forward_fill(spark, sf):
    df = _docs_with_labels(spark, sf).select("doc_id", "quality", "toxic")
    return prepare.forward_fill(df, ["quality", "toxic"], "doc_id")


@query("dedup_rows")
def q_dedup_rows(spark, sf):
    """Full rows: every column but the order takes part, the text too."""
    return prepare.dedup_rows(table(spark, sf, "documents").withColumnRenamed("doc_id", "row_ord"), "row_ord")


@query("dedup_text")
def q_dedup_text(spark, sf):
    cleaned = stored(_docs_clean(spark, sf, "lang"), "clean")
    return prepare.dedup_text(cleaned, "text", "doc_id")


@query("drop_null_rows")
def q_drop_null_rows(spark, sf):
    return prepare.drop_null_rows(_docs_with_labels(spark, sf))


@query("union_datasets")
def q_union_datasets(spark, sf):
    docs = prepare.project(table(spark, sf, "documents"), ["doc_id", "text", "lang"])
    bench = prepare.rename(table(spark, sf, "benchmark"), {"item_id": "doc_id"})
    return prepare.union_datasets([docs, bench], ["documents", "benchmark"])


@query("holdout_split")
def q_holdout_split(spark, sf):
    return prepare.holdout_split(table(spark, sf, "documents"), HOLDOUT_FRAC, "doc_id")


@query("stratified_split")
def q_stratified_split(spark, sf):
    df = (table(spark, sf, "documents").select("doc_id")
          .join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id"))
    return prepare.stratified_split(df, STRATIFIED_FRAC, "doc_id", by="toxic")


@query("stratified_split_nulls")
def q_stratified_split_nulls(spark, sf):
    """D9 with a NULL stratum: all documents, most of them unlabelled."""
    return prepare.stratified_split(_docs_with_labels(spark, sf), STRATIFIED_FRAC, "doc_id", by="toxic")


@query("value_counts")
def q_value_counts(spark, sf):
    return prepare.value_counts(table(spark, sf, "events"), "event_type", "count")


@query("row_counts")
def q_row_counts(spark, sf):
    """D11 before and after text deduplication."""
    cleaned = _docs_clean_shared(spark, sf)
    counts = (prepare.row_count(cleaned), prepare.row_count(prepare.first_orders(cleaned, "text", "doc_id")))
    return spark.createDataFrame([counts], "rows_before long, rows_after long")


@query("preview")
def q_preview(spark, sf):
    return prepare.preview(table(spark, sf, "events").select("event_id", "event_type", "value"),
                           "event_id", 5)


@query("distinct_labels")
def q_distinct_labels(spark, sf):
    return prepare.distinct_labels(table(spark, sf, "events"), "event_type", "event_id")


def _logits(k: int):
    """``k`` logits from the whole vector: sums over every k-th value."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.aggregate(
        F.filter("embedding", lambda _, i: i % k == c), F.lit(0.0), lambda t, x: t + x.cast("double")))


@query("filter_update")
def q_filter_update(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", labels.argmax(_logits(3)).cast("string").alias("pred"))
    df = prepare.with_default_column(df, "prediction", "")
    df = prepare.filter_update(df, F.col("pred") == "0", "prediction", "HOF")
    df = prepare.filter_update(df, F.col("pred") == "1", "prediction", "NOT")
    return df.select("vec_id", "prediction")


@query("align_by_id")
def q_align_by_id(spark, sf):
    return prepare.align_by_id(table(spark, sf, "documents").select("doc_id", "lang"),
                               table(spark, sf, "labels"), "doc_id")


@query("unmatched")
def q_unmatched(spark, sf):
    return prepare.unmatched(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("shuffle_order")
def q_shuffle_order(spark, sf):
    return prepare.shuffle(table(spark, sf, "documents"), "doc_id", SHUFFLE_SEED)


# ------------------------------------------------------------- L1-L7
@query("label_dictionary")
def q_label_dictionary(spark, sf):
    return labels.label_dictionary(table(spark, sf, "events"), "event_type", "event_id")


@query("encode_labels")
def q_encode_labels(spark, sf):
    ev = table(spark, sf, "events")
    # A label that the dictionary lacks passes through: the last one to appear is left out.
    d = stored(labels.label_dictionary(ev, "event_type", "event_id"))
    d = d.where(F.col("label_id") < d.count() - 1)
    return labels.encode_labels(ev, d, "event_type", "label").select("event_id", "label")


def _logit_preds(spark, sf, k: int = LOGIT_CLASSES) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", labels.argmax(_logits(k)).cast("string").alias("pred"))


@query("decode_labels")
def q_decode_labels(spark, sf):
    d = labels.label_dictionary(table(spark, sf, "events"), "event_type", "event_id")
    return labels.decode_labels(_logit_preds(spark, sf), d, "pred", "prediction") \
        .select("vec_id", "prediction")


@query("argmax")
def q_argmax(spark, sf):
    return table(spark, sf, "embeddings").select(
        "vec_id", labels.argmax("embedding").alias("argmax_all"),
        labels.argmax(_logits(LOGIT_CLASSES)).alias("argmax_10"))


def _scored_embeddings(spark, sf) -> DataFrame:
    """truth = label, prediction = argmax over all 64 values (two digits fire the repair)."""
    return table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("string").alias("label"),
        labels.argmax("embedding").cast("string").alias("prediction"))


@query("repair_predictions")
def q_repair_predictions(spark, sf):
    return _scored_embeddings(spark, sf).select(
        "vec_id", labels.repair_predictions("prediction").alias("prediction"))


@query("count_repairs")
def q_count_repairs(spark, sf):
    return labels.count_repairs(_scored_embeddings(spark, sf), "prediction")


@query("majority_label")
def q_majority_label(spark, sf):
    return labels.majority_label(table(spark, sf, "embeddings"), "label")


# ------------------------------------------------------------- A1-A12
def _confusion(spark, sf) -> DataFrame:
    return metrics.confusion(_scored_embeddings(spark, sf), "label", "prediction", repair=True)


@query("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return _confusion(spark, sf)


@query("confusion_wide")
def q_confusion_wide(spark, sf):
    return metrics.confusion_wide(_confusion(spark, sf), [str(k) for k in range(10)])


@query("confusion_restricted")
def q_confusion_restricted(spark, sf):
    return metrics.confusion_restricted(_confusion(spark, sf), ["1", "0"])


@query("binary_cells")
def q_binary_cells(spark, sf):
    return metrics.binary_cells(_confusion(spark, sf), "1", "0")


@query("f1_per_class")
def q_f1_per_class(spark, sf):
    return metrics.f1_per_class(_confusion(spark, sf)).select(
        "class", F.round("f1", 6).alias("f1"), "support")


@query("classification_report")
def q_classification_report(spark, sf):
    rep = metrics.classification_report(_scored_embeddings(spark, sf), "label", "prediction")
    return _report_columns(rep)


def _report_columns(rep) -> DataFrame:
    return rep.select(*[F.round(c, 6).alias(c) for c in
                        ("f1_weighted", "f1_macro", "f1_micro", "accuracy", "mcc")],
                      "n", "n_classes")


@query("classification_report_unlabelled")
def q_classification_report_unlabelled(spark, sf):
    """A12 with gaps in the truth: documents against a prediction, most of them unlabelled."""
    df = _docs_with_labels(spark, sf).select(
        F.col("toxic").cast("string").alias("label"), (F.col("doc_id") % 2).cast("string").alias("prediction"))
    return _report_columns(metrics.classification_report(df)).crossJoin(metrics.unlabelled(df))


@query("classification_report_twelve")
def q_classification_report_twelve(spark, sf):
    """A12 for twelve classes, so ids of two digits, with every seventh prediction out of range."""
    df = table(spark, sf, "events").select(
        (F.col("user_id") % 12).cast("string").alias("label"),
        F.when(F.col("event_id") % 7 == 0, F.lit("12")).when(F.col("event_id") % 5 == 0, F.lit("3"))
        .otherwise((F.col("user_id") % 12).cast("string")).alias("prediction"))
    return _report_columns(metrics.classification_report(df, n_classes=12))


@query("accuracy")
def q_accuracy(spark, sf):
    df = _scored_embeddings(spark, sf).withColumn(
        "prediction", labels.repair_predictions("prediction"))
    return metrics.accuracy(df).select(F.round("accuracy", 6).alias("accuracy"))


@query("mean_loss")
def q_mean_loss(spark, sf):
    df = table(spark, sf, "embeddings").select(
        "vec_id", "label", _logits(LOGIT_CLASSES).alias("logits"))
    batched = encode.assign_batches(df, BATCH_SIZE, "vec_id")
    return metrics.mean_loss(batched, "logits", "label", "batch").select(
        F.round("mean_loss", 6).alias("mean_loss"), "batches")


@query("best_epoch")
def q_best_epoch(spark, sf):
    hist = table(spark, sf, "events").select(
        F.col("user_id").alias("run"), F.col("event_id").alias("epoch"),
        F.col("value").alias("val_loss"))
    return metrics.best_epoch(hist)


# ------------------------------------------------------------- E1-E5
def _vocab_of(docs: DataFrame) -> DataFrame:
    return stored(encode.build_vocabulary(docs, "text"), "vocabulary")


def _vocab(spark, sf) -> DataFrame:
    return _vocab_of(_docs_clean(spark, sf))


@query("vocabulary")
def q_vocabulary(spark, sf):
    return _vocab(spark, sf)


@query("encode_tokens")
def q_encode_tokens(spark, sf):
    """E2 over whole texts: every token of every document, in order."""
    docs = _docs_clean_shared(spark, sf)
    return _ids_as_text(encode.encode_tokens(docs, _vocab_of(docs), "text"))


def _ids_as_text(enc: DataFrame, *more: str) -> DataFrame:
    return enc.select("doc_id", F.array_join(F.col("input_ids").cast("array<string>"), ",").alias("input_ids"),
                      F.size("input_ids").alias("n_tokens"), *more)


@query("truncate_tokens")
def q_truncate_tokens(spark, sf):
    """Ids cut to the model's length, which is the operator."""
    docs = _docs_clean_shared(spark, sf)
    return _ids_as_text(encode.truncate_tokens(encode.encode_tokens(docs, _vocab_of(docs), "text"), MAX_TOKENS))


@query("pad_and_mask")
def q_pad_and_mask(spark, sf):
    """E4 + E5 over whole texts: every batch padded to its own longest row, with the mask."""
    docs = _docs_clean_shared(spark, sf)
    enc = stored(encode.encode_tokens(docs, _vocab_of(docs), "text"), "encoded")  # numbering its rows reads it three times
    padded = encode.pad_and_mask(encode.assign_batches(enc, DOC_BATCH, "doc_id"), batch="batch")
    mask = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return padded.select("doc_id", "batch", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids_md5"),
                         F.size("input_ids").alias("width"), mask.alias("n_tokens"))


@query("assign_batches")
def q_assign_batches(spark, sf):
    return encode.assign_batches(table(spark, sf, "documents"), DOC_BATCH, "doc_id")


# ------------------------------------------------------------- G1-G4
def _lexicon(spark, sf) -> DataFrame:
    b = table(spark, sf, "benchmark").select(X.clean_text(F.col("text")).alias("t"))
    return b.select(F.explode(X.tokens(F.col("t"))).alias("token")).distinct()


@query("augment_drop")
def q_augment_drop(spark, sf):
    return augment.augment_drop(_docs_clean(spark, sf), "text", _lexicon(spark, sf))


@query("augment_drop_emptied")
def q_augment_drop_emptied(spark, sf):
    """G1 over texts of which every fifth cleans to nothing."""
    docs = _docs_clean(spark, sf).withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.lit("")).otherwise(F.col("text")))
    return augment.augment_drop(docs, "text", _lexicon(spark, sf))


@query("augment_replace")
def q_augment_replace(spark, sf):
    docs = _docs_clean_shared(spark, sf)
    v = _vocab_of(docs)  # read by both sides of the rank+1 self-join
    subs = v.alias("a").join(v.alias("b"), F.col("b.token_id") == F.col("a.token_id") + 1).select(
        F.col("a.token").alias("token"), F.col("b.token").alias("substitute"))
    return augment.augment_replace(docs, "text", _lexicon(spark, sf), subs)


@query("augment_generate")
def q_augment_generate(spark, sf):
    """Two tokens per text, drawn one after the other from the corpus' own successors of the last token."""
    docs = _docs_clean_shared(spark, sf)
    base = docs.join(
        table(spark, sf, "labels").select("doc_id", _toxic_label().alias("label")), "doc_id")
    bigrams = stored(augment.bigram_table(docs, "text"), "bigrams")
    toks = X.tokens(F.col("text"))
    last = layout.keep_where(docs.select("doc_id", toks.alias("t")), F.size("t") > 0).select("doc_id", F.element_at("t", -1).alias("last"))
    first = augment.draw_next(last, "doc_id", "last", bigrams, "tok1", "1:42")
    adds = stored(augment.draw_next(first, "doc_id", "tok1", bigrams, "tok2", "2:42"), "additions")
    return augment.augment_generate(base, "text", "label", "doc_id", adds,
                                    _lexicon(spark, sf), "HOF")


@query("with_augmented")
def q_with_augmented(spark, sf):
    base = _docs_clean_shared(spark, sf)
    extra = augment.augment_drop(base, "text", _lexicon(spark, sf))
    return augment.with_augmented(base, [extra], ["base", "drop"])


# ------------------------------------------------------------- S / K round trips
def _roundtrip_dir(spark, tag: str) -> str:
    return scratch_path(spark, f"labeltide-{tag}-{uuid.uuid4().hex}")


@query("csv_roundtrip")
def q_csv_roundtrip(spark, sf):
    """D8 split, K1 writes it as CSV, S1 + S6 read it back by header name."""
    path = _roundtrip_dir(spark, "csv")
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", "text")
    train, dev = prepare.split_frames(prepare.holdout_split(docs, HOLDOUT_FRAC, "doc_id"))
    writers.write_splits(train, dev, path, fmt="csv")
    return delimited.read_csv(spark, path, names=["doc_id", "lang", "source", "text", "split"],
                              types={"doc_id": "bigint"}, order_col=None)


@query("registry_load")
def q_registry_load(spark, sf):
    """A corpus laid out like the hasoc files (derived from documents and
    labels, split by D8, written as CSV) read back through the registry."""
    path = _roundtrip_dir(spark, "corpus")
    lab = table(spark, sf, "labels").select(
        "doc_id", _toxic_label().alias("task_1"),
        F.when(F.col("quality") == 1, F.lit("NONE")).otherwise(F.lit("PRFN")).alias("task_2"))
    corpus = (table(spark, sf, "documents").select("doc_id", "text").join(lab, "doc_id", "left")
              .select(F.col("doc_id").cast("string").alias("_id"), "text", "task_1", "task_2"))
    train, dev = prepare.split_frames(prepare.holdout_split(corpus, HOLDOUT_FRAC, "_id"))
    writers.write_splits(train, dev, path, fmt="csv")
    train, dev, _ = registry.load(spark, "hasoc", {"train": f"{path}/split=train",
                                                    "dev": f"{path}/split=dev"}, task="1")
    return train.unionByName(dev).drop("row_ord")


def _hasoc_rows(spark, sf) -> DataFrame:
    """Documents and labels in the layout of the hasoc files; texts with a quote or a line end stay whole."""
    lab = table(spark, sf, "labels").select(
        "doc_id", _toxic_label().alias("task_1"),
        F.when(F.col("quality") == 1, F.lit("NONE")).otherwise(F.lit("PRFN")).alias("task_2"))
    return (table(spark, sf, "documents").select("doc_id", "text").join(lab, "doc_id", "left")
            .select(F.col("doc_id").cast("string").alias("_id"), "text", "task_1", "task_2"))


def _write_part(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> str:
    (df.write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').option("encoding", encoding)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


@query("registry_combined")
def q_registry_combined(spark, sf):
    """S7 of two training files that share every third row: the overlap counts once, from the first file."""
    base = _roundtrip_dir(spark, "combined")
    rows, n = _hasoc_rows(spark, sf), F.col("_id").cast("long")
    a = _write_part(rows.where(n % 3 != 2), f"{base}/a")
    b = _write_part(rows.where(n % 3 != 1), f"{base}/b")
    dev = _write_part(rows.where(n % 3 == 1), f"{base}/dev")
    train, _, _ = registry.load(spark, "hasoc", {"train": [a, b], "dev": dev}, task="1")
    return train.drop("row_ord")


def _augmented(spark, sf) -> DataFrame:
    """S7 with augmentation rows that repeat the ids of base rows under other texts, and one file of base rows."""
    base = _roundtrip_dir(spark, "augmented")
    rows, n = _hasoc_rows(spark, sf), F.col("_id").cast("long")
    train = _write_part(rows.where(n % 4 != 3), f"{base}/train")
    extra = rows.where(n % 4 == 1).withColumn("text", F.concat(F.lit("again "), "text"))
    more = _write_part(extra.unionByName(rows.where(n % 4 == 2)), f"{base}/more")
    dev = _write_part(rows.where(n % 4 == 3), f"{base}/dev")
    return registry.load(spark, "hasoc", {"train": train, "dev": dev, "augment": more}, task="1", augment=True)[0]


@query("registry_augmented")
def q_registry_augmented(spark, sf):
    return _augmented(spark, sf).drop("row_ord")


@query("encode_augmented")
def q_encode_augmented(spark, sf):
    """E2 over rows of which some share an id: a row out per row in, each with its own tokens."""
    rows = stored(_augmented(spark, sf).withColumn("text", X.clean_text(F.col("text"))), "augmented")
    enc = encode.encode_tokens(rows, _vocab_of(rows), "text")
    return enc.select("id", "source", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids_md5"),
                      F.size("input_ids").alias("n_tokens"))


@query("registry_held_out")
def q_registry_held_out(spark, sf):
    """S7 of a corpus of one file: a share of its rows becomes the dev split (D8), both sides in the result."""
    base = _roundtrip_dir(spark, "olid")
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    path = _write_part(rows.select(F.col("doc_id").alias("id"), F.col("text").alias("tweet"), _toxic_label().alias("subtask_a"),
                                   F.col("quality").cast("string").alias("subtask_b"), F.lit(None).cast("string").alias("subtask_c")), base)
    train, dev, _ = registry.load(spark, "olid", {"train": path}, task="a", dev_frac=HOLDOUT_FRAC)
    sides = train.withColumn("side", F.lit("train")).unionByName(dev.withColumn("side", F.lit("dev")))
    counted = sides.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids"))
    total = sides.agg(F.ceil(F.count(F.lit(1)) * HOLDOUT_FRAC).cast("long").alias("expected_dev"), F.count_distinct("id").alias("all_ids"))
    return counted.crossJoin(total)


@query("tsv_latin1_roundtrip")
def q_tsv_latin1_roundtrip(spark, sf):
    """A Latin-1 TSV with header written and read back; signs outside Latin-1 are written as '?'."""
    path = _roundtrip_dir(spark, "latin1")
    _write_part(table(spark, sf, "documents").select("doc_id", "lang", "text"), path, "\t", delimited.LATIN1)
    return delimited.read_tsv(spark, path, latin1=True, types={"doc_id": "bigint"}, order_col=None)


@query("tsv_utf8_roundtrip")
def q_tsv_utf8_roundtrip(spark, sf):
    """S3: a UTF-8 TSV with header written and read back."""
    path = _roundtrip_dir(spark, "tsv8")
    _write_part(table(spark, sf, "documents").select("doc_id", "lang", "text"), path, "\t")
    return delimited.read_tsv(spark, path, types={"doc_id": "bigint"}, order_col=None)


@query("stream_clean")
def q_stream_clean(spark, sf):
    """The cleaning path as a Structured Streaming query over the documents files."""
    base = _roundtrip_dir(spark, "stream")
    stream_files.clean_table_stream(spark, f"{sf}/documents.parquet", f"{base}/out",
                                    f"{base}/checkpoint", "doc_id")
    return spark.read.parquet(f"{base}/out")


@query("write_predictions")
def q_write_predictions(spark, sf):
    """K2: decoded predictions written as CSV, one folder per task, read back (S1 + S6)."""
    path = _roundtrip_dir(spark, "pred")
    d = labels.label_dictionary(table(spark, sf, "events"), "event_type", "event_id")
    decoded = labels.decode_labels(_logit_preds(spark, sf), d, "pred", "prediction")
    tasks = table(spark, sf, "embeddings").select(
        "vec_id", F.concat(F.lit("label"), F.col("label").cast("string")).alias("task"))
    writers.write_predictions(decoded.select("vec_id", "prediction").join(tasks, "vec_id"), path)
    back = delimited.read_csv(spark, path, names=["vec_id", "prediction", "task"],
                              types={"vec_id": "bigint"}, order_col=None)
    return back


@query("history_best_epoch")
def q_history_best_epoch(spark, sf):
    """K3 + A11: a metric history appended in two disjoint halves, read back, best epoch per run."""
    path = _roundtrip_dir(spark, "history")
    hist = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("run"), F.col("event_id").alias("epoch"),
        F.lit(None).cast("double").alias("train_loss"), F.col("value").alias("val_loss"),
        F.lit(None).cast("double").alias("f1_weighted"), F.lit(None).cast("double").alias("f1_macro"))
    writers.append_metrics(hist.where(F.col("epoch") % 2 == 0), path)
    writers.append_metrics(hist.where(F.col("epoch") % 2 == 1), path)
    return metrics.best_epoch(spark.read.parquet(path))


@query("prediction_lines")
def q_prediction_lines(spark, sf):
    """K4: repaired predictions written one per line in row order, read back as text."""
    path = _roundtrip_dir(spark, "lines")
    scored = _scored_embeddings(spark, sf).select(
        F.col("vec_id").alias("row_ord"), labels.repair_predictions("prediction").alias("prediction"))
    writers.write_prediction_lines(scored, path)
    # The line's number over the part files in name order, as a reader of the files counts it.
    return delimited.read_delimited(spark, path, header=False, names=["value"], null_tokens=None, multiline=False,
                                    order_col="line")


@query("gold_roundtrip")
def q_gold_roundtrip(spark, sf):
    """Headerless gold labels written and read back as (id, label) strings."""
    path = _roundtrip_dir(spark, "gold")
    table(spark, sf, "labels").select("doc_id", "toxic").write.mode("overwrite").csv(path)
    return delimited.read_gold(spark, path, order_col=None)


@query("tsv_headerless_roundtrip")
def q_tsv_headerless_roundtrip(spark, sf):
    """Five-column headerless TSV with assigned names, then D7 rename."""
    path = _roundtrip_dir(spark, "tsv")
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("tno"), F.col("doc_id").alias("art_id"), F.col("lang").alias("keyword"),
        F.col("source").alias("country_code"), F.col("text"))
    (docs.write.mode("overwrite").option("sep", "\t").option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .csv(path))
    back = delimited.read_delimited(
        spark, path, sep="\t", header=False,
        names=["tno", "art_id", "keyword", "country_code", "text"], order_col=None)
    return prepare.rename(back, {"art_id": "_id"}).select(
        F.col("_id").cast("bigint").alias("doc_id"), "keyword", "country_code", "text")


# ------------------------------------------------------------- L8-L10, end to end
def _labelled(spark, sf) -> tuple[DataFrame, DataFrame]:
    docs = _docs_clean_shared(spark, sf)
    lab = table(spark, sf, "labels").select("doc_id", _toxic_label().alias("label"))
    return docs, lab


@query("score_batches")
def q_score_batches(spark, sf):
    """Naive-Bayes weights as a table, fitted by Spark aggregates and applied by blocks of rows: the margin between the classes."""
    docs, lab = _labelled(spark, sf)
    train = docs.join(lab, "doc_id")
    vocab = stored(encode.build_vocabulary(train, "text"), "vocabulary")
    dictionary = stored(labels.label_dictionary(train, "label", "doc_id"), "dictionary")
    # Every document is encoded once; training rows are the labelled ones.
    encoded = blocks.blocked(encode.encode_tokens(docs, vocab, "text", keep_block=True), "encoded")
    train_e = labels.encode_labels(encoded.join(lab, "doc_id"), dictionary, "label", "label_id", as_string=False)
    weights = score.train_token_weights(train_e, "input_ids", "label_id", 2, vocab.count() + encode.FIRST_TOKEN_ID)
    scored = score.score_by_weights(encoded, weights, "input_ids", pred_col="pred_id")
    return labels.decode_labels(scored, dictionary, "pred_id", "prediction").select(
        "doc_id", "prediction", F.round(F.col("logits")[1] - F.col("logits")[0], 4).alias("margin"))


@query("classifier_invariants")
def q_classifier_invariants(spark, sf):
    """L9 + L10 with labels by name, applied to all documents: one row in, one row out, probabilities sum to 1,
    the prediction is the largest, every prediction has a name."""
    docs, lab = _labelled(spark, sf)
    train = docs.join(lab, "doc_id")
    model, dictionary = score.train_named_classifier(train, "text", "label", "doc_id", num_features=1 << 16, max_iter=20)
    out = stored(labels.decode_labels(score.apply_classifier(model, docs, "text"), dictionary, "prediction", "name"), "classified")
    total = F.aggregate("probability", F.lit(0.0), lambda t, x: t + x)
    return out.agg(F.count(F.lit(1)).alias("rows_out"), F.count_distinct("doc_id").alias("ids"),
                   F.count_if(F.abs(total - 1) > 1e-9).alias("bad_sums"),
                   F.count_if(labels.argmax("probability").cast("string") != F.col("prediction")).alias("bad_argmax"),
                   F.count_if(~F.col("name").isin("HOF", "NOT")).alias("unnamed"))


@query("train_classifier")
def q_train_classifier(spark, sf):
    """Spark ML pipeline fitted on labelled documents, applied to all documents."""
    docs, lab = _labelled(spark, sf)
    train = docs.join(lab, "doc_id").withColumn("label", (F.col("label") == "HOF").cast("int"))
    model = score.train_text_classifier(train, "text", "label", num_features=1 << 16, max_iter=20)
    return score.apply_classifier(model, docs, "text").select("doc_id", "prediction")


def _evaluated(spark, sf, fallback: str, given=None) -> DataFrame:
    """Read, clean, dictionary, encode, score, decode, join gold by id, report: train on two thirds of the labelled
    documents, report on the rest."""
    rows = (table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id")
            .select(F.col("doc_id").cast("string").alias("id"), "text", _toxic_label().alias("label"), F.col("doc_id").alias("row_ord")))
    rows = stored(rows, "rows")
    held = F.col("row_ord") % 3 == 0
    _, report, missing = evaluate.score_and_evaluate(
        rows.where(~held), rows.where(held).drop("label"), rows.where(held).select("id", "label"), fallback=fallback, given=given)
    return _report_columns(report).crossJoin(missing.agg(F.count(F.lit(1)).alias("unmatched")))


@query("score_evaluate_report")
def q_score_evaluate_report(spark, sf):
    return _evaluated(spark, sf, "0")


@query("score_evaluate_majority")
def q_score_evaluate_majority(spark, sf):
    """The same with predictions of which some are empty or no class id: they get L7's majority label."""
    n = F.col("id").cast("long")
    return _evaluated(spark, sf, "majority", F.when(n % 5 == 0, F.lit("")).when(n % 7 == 0, F.lit("9")).otherwise(F.col("pred_id")))


NO_ORACLE = {"train_classifier"}


def write_outputs(spark: SparkSession, sf: str, out: str) -> None:
    """K2-K4 on the scored documents (used by tests and by the CLI bench)."""
    scored = QUERIES["score_batches"](spark, sf).withColumn("task", F.lit("toxic"))
    writers.write_predictions(scored, f"{out}/predictions")
    writers.write_prediction_lines(scored.withColumn("row_ord", F.col("doc_id")), f"{out}/lines")


from . import flows  # noqa: E402,F401  registers the end-to-end flows
