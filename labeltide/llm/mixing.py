"""Operator 6: mixing sources to target weights by Pareto order sampling.

Sources get weights in code-point order (nulls last).  Their targets share all
words by weight, none above ``max_copies`` times its own size; the excess of
such sources is shared by the others (water filling, solved in closed form over
one row per source).

Within a source a document's expected number of copies is proportional to the
whole root of its size (``size_measure``), so that a long document weighs more
than a short one but not in proportion to its words, and at most ``max_copies``;
the factor makes the expected words equal the target.  It is solved over one
row per source and size.  The whole part of that number is taken for certain.
The rest is the document's own inclusion odds in a Pareto order sample:
documents rank by the odds of a random number over their inclusion odds, and a
sample of any size is the first so many.  Its size is the largest whose words
fit into what the certain copies leave of the target; then the later documents
that still fit are taken, in the same order, so that what stays open is less
than the smallest document passed over.  The random number is the MD5 of id and
seed, so reruns agree.

The order is never computed over a whole source: ranks fall into ``BINS`` equal
bins, and word totals per source and bin tell which bin the sample ends in.  From
there on, bins are looked at in runs of about ``run_rows`` documents that may fit.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltide.llm.common import WORD_PATTERN, Stage

WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_copies: int = 3,
                   share: float = 1.0) -> DataFrame:
    """``sizes`` (source, source_size) with each source's ``target``; works on one row per source."""
    whole = Window.partitionBy(F.lit(0))
    order = whole.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("w", F.get(cycle, (F.row_number().over(order) - 1) % len(weights)))
    # Sources reach their limit in the order of size over weight.
    filled = whole.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("source_size") * F.lit(max_copies)
    total = F.sum("source_size").over(whole) * F.lit(share)
    level = (total - F.coalesce(F.sum(limit).over(before), F.lit(0))) / (
        F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    stepped = (weighed.withColumn("level", level).withColumn("place", F.row_number().over(filled))
               .withColumn("capped", F.col("level") * F.col("w") >= F.col("source_size") * F.lit(max_copies))
               .withColumn("open_level", F.min(F.when(~F.col("capped"), F.struct("place", "level"))).over(whole)["level"]))
    target = F.when(F.col("capped"), limit.cast("double")).otherwise(F.col("open_level") * F.col("w"))
    return stepped.select("source", "source_size", target.alias("target"))


def pareto_rank(key: Column, chance: Column, seed: int) -> Column:
    """Random odds over inclusion odds, as q / (1 + q): in [0, 1], ascending with the rank."""
    digits = F.substring(F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 13)
    u = (F.conv(digits, 16, 10).cast("long").cast("double") + 0.5) / F.lit(float(1 << 52))
    q = (u / (1 - u)) / (chance / (1 - chance))
    return q / (1 + q)


BINS = 1 << 16


def size_measure(size: Column) -> Column:
    """What a document's expected copies are proportional to: the whole part of the root of its size."""
    return F.floor(F.sqrt(size)).cast("long")


def copy_factors(sized: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """``targets`` with ``factor``: expected copies over ``size_measure``; null where every document is taken ``max_copies`` times.

    ``sized`` is (_source, _size).  From the largest size down, sizes are held at ``max_copies`` until
    the factor that shares the rest of the target among the others keeps the next size below that.
    """
    sizes = sized.where("_size > 0").groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("c"))
    down = Window.partitionBy("_source").orderBy(F.desc("_size"))
    words = F.col("_size") * F.col("c")
    sizes = (sizes.withColumn("held", F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("open", F.sum(size_measure(F.col("_size")) * words).over(down.rowsBetween(0, Window.unboundedFollowing))))
    solved = sizes.join(targets, F.col("_source").eqNullSafe(F.col("source"))).withColumn(
        "factor", (F.col("target") - F.col("held") * max_copies) / F.col("open"))
    fits = solved.where((F.col("target") < F.col("source_size") * max_copies) & (F.col("factor") * size_measure(F.col("_size")) <= max_copies))
    best = fits.groupBy(F.col("source").alias("_of")).agg(F.max_by("factor", "_size").alias("factor"))
    return targets.join(best, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of")


def _picks(run: "pandas.DataFrame") -> "pandas.DataFrame":
    """Of a source's documents of a run of bins, in order, those that fit into what is left when they come."""
    run = run.sort_values(["rank", "_id", "_size"], na_position="first", kind="stable")
    left, take = float(run["left"].iloc[0]), []
    for size in run["_size"].to_numpy():
        take.append(size <= left)
        left -= size if take[-1] else 0
    return run.loc[take, ["_source", "rank", "_id", "_size"]]


def _fill(stage: Stage, ranked: DataFrame, cuts: DataFrame, run_rows: int) -> tuple[DataFrame, DataFrame]:
    """(picks, cuts): documents taken from the cut bin on, and per source the last bin that was looked at.

    Each turn looks at the next bins of every source that has room left, together at least
    ``run_rows`` documents that may still fit, and ends when no later document fits anywhere.
    """
    shape = ranked.select("_source", "rank", "_id", "_size").schema
    later = stage.put(ranked.join(cuts, F.col("_source").eqNullSafe(F.col("cut_source")))
                      .where("bin >= cut_bin and _size <= left").select("_source", "rank", "bin", "_id", "_size"), "later")
    picks = stage.put(later.select("_source", "rank", "_id", "_size").where(F.lit(False)), "picks-0")
    state, turn = stage.put(cuts.select("cut_source", F.col("cut_bin").alias("from"), "left"), "state-0"), 0
    while True:
        open_ = later.join(state, F.col("_source").eqNullSafe(F.col("cut_source"))).where("bin >= from and _size <= left")
        bins = open_.groupBy("cut_source", "bin", "left").agg(F.count(F.lit(1)).alias("c"))
        ahead = F.sum("c").over(Window.partitionBy("cut_source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
        ends = (bins.withColumn("ahead", F.coalesce(ahead, F.lit(0))).where(F.col("ahead") < run_rows)
                .groupBy(F.col("cut_source").alias("end_source")).agg(F.max("bin").alias("end_bin")))
        ends = stage.put(ends, f"ends-{turn}")
        if ends.isEmpty():
            return picks, state.select("cut_source", (F.col("from") - 1).alias("last_bin"))
        run = open_.join(ends, F.col("cut_source").eqNullSafe(F.col("end_source"))).where("bin <= end_bin")
        found = stage.put(run.select("_source", "rank", "_id", "_size", "left").groupBy("_source").applyInPandas(_picks, shape), f"found-{turn}")
        spent = found.groupBy(F.col("_source").alias("spent_source")).agg(F.sum("_size").alias("spent"))
        moved = (state.join(ends, F.col("cut_source").eqNullSafe(F.col("end_source")), "left")
                 .join(spent, F.col("cut_source").eqNullSafe(F.col("spent_source")), "left")
                 .select("cut_source", F.coalesce(F.col("end_bin") + 1, F.col("from")).alias("from"),
                         (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left")))
        turn += 1
        state = stage.put(moved, f"state-{turn}")
        picks = stage.put(picks.union(found), f"picks-{turn}")
        stage.drop(f"picks-{turn - 1}", f"found-{turn - 1}", f"ends-{turn - 1}", f"state-{turn - 1}")


def taken_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: Sequence[float] = WEIGHTS, max_copies: int = 3, share: float = 1.0, seed: int = 1,
                run_rows: int = 10_000, extra: Sequence[Column] = ()) -> DataFrame:
    """Per row: ``id_col``, ``extra``, source, size, source_size, target, copies, taken.

    A document of size 0 is not taken.  Rows that share an id share its random number and
    are ordered by size; of equal rows, which are interchangeable, as many are taken as fit.
    Null ids rank as an empty string and come first, null sources are one source, null texts
    have size 0.  A source without words has target 0.  An empty table gives no rows.
    """
    stage = Stage(docs.sparkSession, "mixing")
    own = [F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size")]
    sized = stage.put(docs.select(*own), "sizes")
    totals = sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_size").alias("source_size"))
    targets = stage.put(source_targets(totals, weights, max_copies, share), "shares")
    targets = stage.put(copy_factors(sized.select("_source", "_size"), targets, max_copies), "targets")
    expected = F.when(F.col("_size") == 0, F.lit(0.0)).when(F.col("factor").isNull(), F.lit(float(max_copies))).otherwise(
        F.least(F.col("factor") * size_measure(F.col("_size")), F.lit(float(max_copies))))
    drawn = F.col("chance") > 0

    def rank(rows: DataFrame) -> DataFrame:
        return (rows.join(targets, F.col("_source").eqNullSafe(F.col("source")), "left")
                .withColumn("_expected", expected).withColumn("whole", F.floor("_expected").cast("long"))
                .withColumn("chance", F.col("_expected") - F.floor("_expected")).drop("_expected")
                .withColumn("rank", F.when(drawn, pareto_rank(F.col("_id"), F.col("chance"), seed)))
                .withColumn("bin", F.when(drawn, F.least(F.floor(F.col("rank") * BINS).cast("int"), F.lit(BINS - 1)))))

    ranked = rank(sized)
    bins = stage.put(ranked.groupBy("_source", "bin").agg(F.sum("_size").alias("words"), F.sum(F.col("whole") * F.col("_size")).alias("certain")), "bins")
    certain = bins.groupBy(F.col("_source").alias("_of")).agg(F.sum("certain").alias("certain"))
    rest = certain.join(targets, F.col("_of").eqNullSafe(F.col("source"))).select("_of", (F.col("target") - F.col("certain")).alias("rest"))
    up_to = Window.partitionBy("_source").orderBy("bin")
    cuts = (bins.where("bin is not null").withColumn("upto", F.sum("words").over(up_to))
            .join(rest, F.col("_source").eqNullSafe(F.col("_of"))).where("upto > rest")
            .groupBy(F.col("_source").alias("cut_source"), "rest").agg(F.min(F.struct("bin", (F.col("upto") - F.col("words")).alias("below"))).alias("cut")))
    cuts = stage.put(cuts.select("cut_source", F.col("cut.bin").alias("cut_bin"), (F.col("rest") - F.col("cut.below")).alias("left")), "cuts")
    picks, lasts = _fill(stage, ranked, cuts, run_rows)
    cuts = stage.put(cuts.join(lasts.withColumnRenamed("cut_source", "_of"), F.col("cut_source").eqNullSafe(F.col("_of"))).select("cut_source", "cut_bin", "last_bin"), "looked")
    picks = picks.groupBy("_source", "rank", "_id", "_size").agg(F.count(F.lit(1)).alias("picked"))
    picks = stage.put(picks.select(*[F.col(c).alias(f"p{c}") for c in ("_source", "rank", "_id", "_size")], "picked"), "picked")
    # Rows with further columns are read and sized again, so that no copy of them is stored.
    rows = docs.select(*own, *extra) if extra else sized
    ranked = rank(rows).join(cuts, F.col("_source").eqNullSafe(F.col("cut_source")), "left")
    looked = F.coalesce(F.col("bin").between(F.col("cut_bin"), F.col("last_bin")), F.lit(False))
    same = [F.col(c).eqNullSafe(F.col(f"p{c}")) for c in ("_source", "rank", "_id", "_size")]
    edge = ranked.where(looked).join(picks, same[0] & same[1] & same[2] & same[3], "left")
    alike = Window.partitionBy("_source", "rank", "_id", "_size").orderBy(F.lit(0))
    edge = edge.withColumn("more", F.coalesce(F.row_number().over(alike) <= F.col("picked"), F.lit(False)).cast("int"))
    clear = ranked.where(~looked)
    clear = clear.withColumn("more", F.when(drawn & (F.col("cut_bin").isNull() | (F.col("bin") < F.col("cut_bin"))), 1).otherwise(0))
    names = [c for c in rows.columns if c not in ("_id", "_source", "_size")]
    columns = [F.col("_id").alias(id_col), *names, F.col("_source").alias("source"), F.col("_size").alias("size"), "source_size", "target",
               (F.col("whole") + F.col("more")).alias("copies"), ((F.col("whole") + F.col("more")) * F.col("_size")).alias("taken")]
    stage.drop("shares", "later", "bins", *(["sizes"] if extra else []))
    return clear.select(*columns).unionByName(edge.select(*columns))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: each row as often as the mix takes it, with the columns of ``docs``."""
    whole = F.struct(*docs.columns).alias("_row")
    mixed = taken_words(docs, id_col, text_col, source_col, extra=[whole], **options)
    repeated = mixed.where("copies > 0").select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return repeated.select("_row.*")
