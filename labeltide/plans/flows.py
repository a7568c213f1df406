"""End-to-end flows, registered as queries: files in, predictions or prepared files out, read back.

The files stand in for the corpora: they are written from the driver tables in the
layout that the registry expects.  What follows is the library's own work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import labels, metrics, prepare, score
from ..session import stored
from ..sinks import writers
from ..sources import delimited, registry
from . import catalog, evaluate
from .catalog import HOLDOUT_FRAC, _report_columns, _roundtrip_dir, _write_part, query, table


def _labelled_rows(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source").join(table(spark, sf, "labels"), "doc_id")


def _plain(df: DataFrame, path: str, sep: str) -> str:
    (df.write.mode("overwrite").option("sep", sep).option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


@query("olid_tasks")
def q_olid_tasks(spark, sf):
    """Per task: test TSV and headerless gold, train, score, decode, report by id, predictions in a file per task, read back."""
    base = _roundtrip_dir(spark, "olid-tasks")
    name = {"a": ("toxic", "OFF", "NOT"), "b": ("quality", "UNT", "TIN")}
    rows = stored(_labelled_rows(spark, sf).select(
        F.col("doc_id").alias("id"), F.col("text").alias("tweet"),
        *[F.when(F.col(c) == 1, yes).otherwise(no).alias(f"subtask_{t}") for t, (c, yes, no) in name.items()], F.lit(None).cast("string").alias("subtask_c")), "olid")
    part = rows["id"] % 3
    train = _write_part(rows.where(part == 1).orderBy("id"), f"{base}/train")
    dev = _write_part(rows.where(part == 2).orderBy("id"), f"{base}/dev")
    test = _write_part(rows.where(part == 0).select("id", "tweet"), f"{base}/test", sep="\t")
    reports, written = [], f"{base}/predictions"
    # The tasks share the files and the texts: both are read, counted and encoded once, with a label column per task.
    fit, _, asked = registry.load_tasks(spark, "olid", {"train": train, "dev": dev, "test": test}, tasks=list(name))
    fitted = evaluate.fit_and_score_tasks(fit, asked.select("id", "text"), [f"label_{task}" for task in name])
    for task, of_task in zip(name, fitted):
        gold = _plain(rows.where(part == 0).select("id", f"subtask_{task}"), f"{base}/gold-{task}", ",")
        scored, report, missing = evaluate.evaluated(*of_task, registry.load_gold(spark, gold), label_col=f"label_{task}")
        writers.write_predictions(scored.select("id", "prediction", F.lit(task).alias("task")), written, mode="overwrite" if not reports else "append")
        reports.append(_report_columns(report).crossJoin(missing.agg(F.count(F.lit(1)).alias("unmatched"))).withColumn("task", F.lit(task)))
    back = delimited.read_csv(spark, written, names=["id", "prediction", "task"], order_col=None)
    files = back.groupBy("task").agg(F.count(F.lit(1)).alias("written"), F.count_if(F.col("prediction").isin("OFF", "UNT")).alias("positive"))
    return reports[0].unionByName(reports[1]).join(files, "task")


@query("pcl_flow")
def q_pcl_flow(spark, sf):
    """Headerless five-column test file: clean, count, prefix, dictionary, score, repair what is no single sign, count the repairs."""
    base = _roundtrip_dir(spark, "pcl-flow")
    rows = stored(_labelled_rows(spark, sf), "pcl")
    part = rows["doc_id"] % 3
    train = _write_part(rows.where(part == 1).orderBy("doc_id").select(F.col("doc_id").alias("par_id"), "text", F.col("quality").cast("string").alias("label")), f"{base}/train")
    dev = _write_part(rows.where(part == 2).select(F.col("doc_id").alias("par_id"), "text", F.col("quality").cast("string").alias("label")), f"{base}/dev")
    test = _plain(rows.where(part == 0).select(F.col("doc_id").alias("tno"), F.col("doc_id").alias("art_id"), F.col("lang").alias("keyword"),
                                               F.col("source").alias("country_code"), "text"), f"{base}/test", "\t")
    fit, _, asked = registry.load(spark, "pcl", {"train": train, "dev": dev, "test": test})
    asked = stored(asked.withColumn("text", X.clean_text(F.col("text"))), "asked")
    scored, dictionary, _ = evaluate.fit_and_score(fit, asked)
    n = F.col("id").cast("long")
    # Stands in for a text generator, which may answer with nothing or with a word.
    answers = labels.decode_labels(scored, dictionary, "pred_id", "said").withColumn(
        "said", F.when(n % 11 == 0, F.lit("")).when(n % 13 == 0, F.lit("positive")).otherwise(F.col("said")))
    answers = stored(answers.select("id", "said"), "answers")
    repairs = labels.count_repairs(answers, "said")
    out = (asked.select("id", X.add_prefix(F.col("text")).alias("text"))
           .join(answers.select("id", labels.repair_predictions("said").alias("prediction")), "id"))
    return out.crossJoin(repairs).crossJoin(asked.agg(F.count(F.lit(1)).alias("rows"))).select(
        F.col("id").cast("bigint").alias("doc_id"), F.md5("text").alias("text_md5"), "prediction", "repaired", "rows")


@query("preparation_flow")
def q_preparation_flow(spark, sf):
    """Latin-1 TSV with gaps, filled forward; a tenth held out; both sides written as CSV and read back (layout ``sema``)."""
    base = _roundtrip_dir(spark, "preparation")
    rows = table(spark, sf, "documents").select("doc_id", "text").join(table(spark, sf, "labels"), "doc_id", "left")
    path = _write_part(rows.orderBy("doc_id").select(F.col("doc_id").alias("id"), "text", F.col("toxic").cast("string").alias("HS")),
                       f"{base}/sema", sep="\t", encoding=delimited.LATIN1)
    train, dev, _ = registry.load(spark, "sema", {"train": path}, dev_frac=HOLDOUT_FRAC)
    writers.write_splits(train.select("row_ord", "text", "label"), dev.select("row_ord", "text", "label"), f"{base}/splits", fmt="csv")
    back = delimited.read_csv(spark, f"{base}/splits", names=["row_ord", "text", "label", "split"], types={"row_ord": "bigint"}, order_col=None)
    return back.select("row_ord", F.md5("text").alias("text_md5"), "label", "split")


@query("classifier_certificate")
def q_classifier_certificate(spark, sf):
    """L9's fit, certified: the gradient of the regularised loss over all training rows is near zero at its coefficients."""
    docs, lab = catalog._labelled(spark, sf)
    train = stored(docs.join(lab, "doc_id").select("text", (F.col("label") == "HOF").cast("int").alias("label")), "certified")
    model = score.train_text_classifier(train, "text", "label", num_features=1 << 12, max_iter=300, reg_param=0.1, tolerance=1e-12)
    found = score.fit_gradient(model, train, "text", "label", 0.1)
    return found.select("n", (F.greatest("gradient", "intercept_gradient") < 1e-4).alias("gradient_small"))


# ------------------------------------------------------------- single faults that tables seldom show
@query("csv_swapped_headers")
def q_csv_swapped_headers(spark, sf):
    """S1 of one folder whose files hold the same columns in another order, and some files with a column more."""
    base = _roundtrip_dir(spark, "swapped")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", "lang", "source")
    for k, cols in enumerate((["doc_id", "text", "lang"], ["lang", "doc_id", "text"], ["text", "source", "doc_id", "lang"])):
        part = docs.where(F.col("doc_id").cast("long") % 3 == k).select(*cols)
        (part.write.mode("append").option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False).csv(base))
    return delimited.read_csv(spark, base, types={"doc_id": "bigint"}, order_col=None).select("doc_id", "text", "lang", "source")


@query("gold_listed_order")
def q_gold_listed_order(spark, sf):
    """S5 of several headerless files given in an order that is not that of their names: rows are numbered as listed."""
    base, lab = _roundtrip_dir(spark, "gold-listed"), table(spark, sf, "labels").select("doc_id", "toxic")
    paths = [_plain(lab.where(F.col("doc_id") % 2 == k).orderBy("doc_id"), f"{base}/{name}", ",") for k, name in enumerate(("z", "b"))]
    return delimited.read_gold(spark, paths, order_col="place")


@query("accuracy_missing")
def q_accuracy_missing(spark, sf):
    """A8 where some predictions are missing: they are wrong, and the report (A12) says the same."""
    lab = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("label"),
                                            F.when(F.col("doc_id") % 4 != 0, F.col("toxic").cast("string")).alias("prediction"))
    return metrics.accuracy(lab)


@query("holdout_repeated_keys")
def q_holdout_repeated_keys(spark, sf):
    """D8 by a key that many rows share: exactly the share is held out; rows held per key."""
    items = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber")
    marked = prepare.holdout_split(items, HOLDOUT_FRAC, "l_suppkey")
    return marked.groupBy("l_suppkey").agg(F.count_if(F.col("split") == "dev").alias("held"), F.count(F.lit(1)).alias("n"))
