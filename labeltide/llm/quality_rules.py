"""Operator 8: quality rules whose cutoffs are certified on labelled documents.

Counts per text are built-in functions only (no Python on the rows).  Each rule
rejects texts whose rate lies above a cutoff.  For every stratum and rule the
cutoffs are tried from lenient to strict on the labelled good documents: a
cutoff is certified if an exact binomial test shows, at level
``delta / (strata * rules)``, that it rejects less than ``alpha / rules`` of the
good ones.  Testing stops at the first failure (a fixed sequence needs no
further correction along its cutoffs; strata and rules are Bonferroni's), and
the strictest certified cutoff holds.  A stratum with too few labels to certify
anything rejects nothing beyond the base rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labeltide.llm.common import SPACE_CLASS, WORD_PATTERN, Stage, let
from labeltide.operators.layout import keep_where

WINDOW = 5
SYMBOLS = "#*$%&|<>"
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Cutoffs of each rule, lenient to strict.
RULES: dict[str, tuple[float, ...]] = {
    "symbol_rate": (0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05),
    "dup_line_rate": (0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.25, 0.2),
    "repeat_rate": (0.19, 0.17, 0.15, 0.13, 0.11, 0.1, 0.09, 0.08),
}
ALPHA, DELTA = 0.05, 0.05


def _covered(windows: Column) -> Column:
    """Positions that lie in a window whose hash occurs twice or more."""
    pairs = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def twice(p: Column) -> Column:
        return F.sort_array(F.transform(F.filter(
            p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"])), lambda x: x["i"]))

    def span(q: Column) -> Column:
        steps = F.transform(q, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(q, k + 1) - x, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return let(pairs, lambda p: let(twice(p), span))


def text_counts(text: Column) -> Column:
    """A struct of ``METRICS``; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w: Column) -> Column:
        windows = F.when(F.size(w) >= WINDOW, F.transform(
            F.sequence(F.lit(0), F.size(w) - WINDOW),
            lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)])))
        repeats = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _covered(h)))
        return F.struct(F.size(w).cast("long").alias("n_words"),
                        F.coalesce(repeats, F.lit(0)).cast("long").alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("long").alias("n_lines"),
                        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    # Each space character ends a piece: their number gives the characters outside words.
    words = let(F.split(text, SPACE_CLASS), lambda pieces: F.struct(
        (F.length(text) - F.size(pieces) + 1).cast("long").alias("word_chars"),
        let(F.array_remove(pieces, ""), of_words).alias("counts")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_PATTERN)), of_lines)
    symbols = F.size(F.split(text, f"[{SYMBOLS}]")) - 1
    return F.struct(words.alias("words"), lines.alias("lines"), symbols.cast("long").alias("n_symbols"))


def with_counts(docs: DataFrame, keep: list[Column], text_col: str) -> DataFrame:
    """``keep`` and the columns ``METRICS``."""
    found = docs.select(*keep, text_counts(F.col(text_col)).alias("found"))
    place = {"n_words": "found.words.counts.n_words", "n_repeat_words": "found.words.counts.n_repeat_words",
             "word_chars": "found.words.word_chars", "n_lines": "found.lines.n_lines", "n_dup_lines": "found.lines.n_dup_lines"}
    return found.select(*[c for c in found.columns if c != "found"], *[F.col(place.get(m, f"found.{m}")).alias(m) for m in METRICS])


def rates() -> dict[str, Column]:
    """The value that each rule compares with its cutoff."""
    ratio = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {"symbol_rate": ratio("n_symbols", "word_chars"), "dup_line_rate": ratio("n_dup_lines", "n_lines"),
            "repeat_rate": ratio("n_repeat_words", "n_words")}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k), X binomial of ``n`` and ``p``, summed exactly in logs; 1 where k is not below the mean."""
    step = F.aggregate(
        F.sequence(F.lit(1).cast("long"), k),
        F.struct((n * F.log(F.lit(1 - p))).alias("term"), F.exp(n * F.log(F.lit(1 - p))).alias("total")),
        lambda s, j: let(s["term"] + F.log((n - j + 1) / j) + F.log(F.lit(p / (1 - p))),
                         lambda t: F.struct(t.alias("term"), (s["total"] + F.exp(t)).alias("total"))),
        lambda s: s["total"])
    return (F.when(k >= n * F.lit(p), F.lit(1.0))
            .when(k == 0, F.exp(n * F.log(F.lit(1 - p)))).otherwise(step))


def certified_cutoffs(good: DataFrame, stratum: str, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum of ``good`` (rows with METRICS): the strictest certified cutoff of each rule, or null."""
    value = rates()
    counts = good.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count_if(value[r] > c).alias(f"{r}_{i}") for r, cuts in RULES.items() for i, c in enumerate(cuts)])
    n_tests = F.count(F.lit(1)).over(_whole()) * len(RULES)
    level = counts.withColumn("level", F.lit(delta) / n_tests)
    columns = []
    for r, cuts in RULES.items():
        best, open_ = F.lit(None).cast("double"), F.lit(True)
        for i, c in enumerate(cuts):
            open_ = open_ & (binomial_tail(F.col(f"{r}_{i}"), F.col("n"), alpha / len(RULES)) <= F.col("level"))
            best = F.when(open_, F.lit(c)).otherwise(best)
        columns.append(best.alias(f"cut_{r}"))
    return level.select(F.col(stratum), *columns)


def _whole():
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(0))  # over one aggregated row per stratum


def cutoffs_of(stage: Stage, docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, stratum_col: str,
               alpha: float, delta: float) -> tuple[DataFrame, DataFrame]:
    """(counts, cutoffs): (_id, _stratum, METRICS) of every row, and the certified cutoffs per stratum ``_of``."""
    counted = stage.put(with_counts(docs, [F.col(id_col).alias("_id"), F.col(stratum_col).alias("_stratum")], text_col), "counts")
    good_ids = labels.where("quality = 1").select(F.col("doc_id").alias("_id")).distinct()
    good = counted.where(~base_failed()).join(good_ids, "_id", "left_semi")
    cuts = stage.put(certified_cutoffs(good, "_stratum", alpha, delta), "cutoffs")
    return counted, cuts.withColumnRenamed("_stratum", "_of")


def judged(counted: DataFrame, cuts: DataFrame) -> DataFrame:
    """``counted`` with base_failed and kept."""
    broken = F.lit(False)
    for r, value in rates().items():
        broken = broken | F.coalesce(value > F.col(f"cut_{r}"), F.lit(False))
    out = counted.join(cuts, F.col("_stratum").eqNullSafe(F.col("_of")), "left")
    return out.select(*counted.columns, base_failed().alias("base_failed"), (~base_failed() & ~broken).alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The verdict of every row: ``id_col``, METRICS, base_failed, kept.

    ``labels`` is (doc_id, quality); an id with a label 1 counts as good, and ids are
    compared as they are, so rows that share a good id are all good.  Good rows that fail
    the base rules are no evidence for or against a cutoff.  Null texts count as empty,
    null strata as a stratum of their own, null ids as unlabelled.  Without labels no
    cutoff is certified; an empty table gives no rows.  Other columns are ignored.
    """
    stage = Stage(docs.sparkSession, "quality-rules")
    counted, cuts = cutoffs_of(stage, docs, labels, id_col, text_col, stratum_col, alpha, delta)
    return judged(counted, cuts).select(F.col("_id").alias(id_col), *METRICS, "base_failed", "kept")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             stratum_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that :func:`quality_rules` keeps, with their columns, whatever these are named.

    The rows are counted again as they are filtered, so that no copy of the texts is stored.
    """
    stage = Stage(docs.sparkSession, "quality-rules")
    _, cuts = cutoffs_of(stage, docs, labels, id_col, text_col, stratum_col, alpha, delta)
    stage.drop("counts")
    counted = with_counts(docs, [F.col(stratum_col).alias("_stratum"), F.struct("*").alias("_row")], text_col)
    return keep_where(judged(counted, cuts).select("_row", "kept"), F.col("kept")).select("_row.*")
