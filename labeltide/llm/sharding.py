"""Operator 7: shards of nearly equal bytes from a k-d tree over document metadata.

Rows with equal texts are one group and share a shard.  A group that alone
reaches the target bytes gets a shard of its own (there are at most as many as
shards).  The others are split recursively: a node that is to become k shards
is cut where floor(k/2)/k of its bytes lie below, along the metadata dimension
that is widest in it, until every leaf is one shard.  All nodes of a level are
cut at once by distributed weighted medians: bytes per cell of the dimension
tell the cell that the cut lies in, bytes per hash interval inside that cell
tell where.  The driver sees one row per node, so at most one per shard.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltide.llm.common import Stage

CELLS = 1 << 16


def document_dimensions(id_col: str, text_col: str) -> dict[str, Column]:
    """Doubles that depend on the text or are the least over its copies: id, length and bytes per character."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return {"id": F.coalesce(F.col(id_col).cast("double"), F.lit(0.0)),
            "length": F.log2(F.octet_length(text) + F.lit(16.0)),
            "density": F.octet_length(text) / F.greatest(F.length(text), F.lit(1))}


def _share_below(weights: DataFrame, place: str, keys: list[str]) -> DataFrame:
    """Per ``node``, the first ``place`` up to which the weight reaches ``need``, and what of ``need`` is left there."""
    up_to = Window.partitionBy("node").orderBy(place)
    found = weights.withColumn("upto", F.sum("w").over(up_to)).where("upto >= need")
    best = found.groupBy("node").agg(F.min_by(F.struct(F.col(place).alias("at"), (F.col("need") - F.col("upto") + F.col("w")).alias("left"), "w", *keys), place).alias("b"))
    return best.select("node", "b.*")


def _cut_level(spark, members: DataFrame, nodes: dict[int, int], dims: list[str], spans: dict[str, float]) -> dict[int, tuple]:
    """For each node (first shard -> number of shards, over 1): dimension, low end, cell width, cell and hash interval of its cut."""
    stats = {r["node"]: r for r in members.groupBy("node").agg(
        F.sum("w").alias("w"), *[f(d).alias(f"{f.__name__}_{d}") for d in dims for f in (F.min, F.max)]).collect()}
    rows = []
    for node, k in nodes.items():
        r = stats.get(node)
        if k > 1 and r is not None:
            d = max(dims, key=lambda d: (r[f"max_{d}"] - r[f"min_{d}"]) / spans[d] if spans[d] else 0.0)
            low, width = r[f"min_{d}"], (r[f"max_{d}"] - r[f"min_{d}"]) / (CELLS - 1) or 1.0
            rows.append((node, dims.index(d), float(low), float(width), float(r["w"]) * (k // 2) / k))
    if not rows:
        return {}
    plan = spark.createDataFrame(rows, "node int, dim int, low double, width double, need double")
    placed = members.join(F.broadcast(plan), "node").withColumn("cell", _cell(dims))
    weights = placed.groupBy("node", "cell", "need").agg(F.sum("w").alias("w"))
    cells = {r["node"]: r for r in _share_below(weights, "cell", []).collect()}
    inner = spark.createDataFrame([(n, r["at"], float(r["left"])) for n, r in cells.items()], "node int, cell long, need double")
    fine = (placed.drop("need").join(F.broadcast(inner), ["node", "cell"])
            .withColumn("slice", F.floor(F.col("t") * CELLS)).groupBy("node", "slice", "need").agg(F.sum("w").alias("w")))
    slices = {r["node"]: r for r in _share_below(fine, "slice", []).collect()}
    out = {}
    for node, dim, low, width, _ in rows:
        at = slices[node]
        # The slice that holds the cut goes to the side that it lies nearer to.
        out[node] = (dim, low, width, cells[node]["at"], at["at"] + (1 if 2 * at["left"] > at["w"] else 0))
    return out


def _cell(dims: list[str]) -> Column:
    value = F.get(F.array(*dims), F.col("dim"))
    return F.floor((value - F.col("low")) / F.col("width")).cast("long")


def shard_groups(groups: DataFrame, dims: list[str], shards: int) -> DataFrame:
    """``groups`` (digest, w, t, ``dims``) with the int column ``shard``, 0 to ``shards`` - 1."""
    spark = groups.sparkSession
    total = groups.agg(F.sum("w").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    weight, left, heavy = float(total["w"] or 0), shards, []
    large = groups.where(F.col("w") * shards >= weight).select("digest", "w").orderBy(F.col("w").desc(), "digest").limit(shards).collect()
    for r in large:
        if left > 1 and r["w"] * left >= weight:
            heavy.append((r["digest"], len(heavy)))
            weight, left = weight - r["w"], left - 1
    members = groups.withColumn("node", F.lit(len(heavy)))
    if heavy:
        own = spark.createDataFrame(heavy, "digest binary, own int")
        members = members.join(F.broadcast(own), "digest", "left").withColumn("node", F.coalesce("own", "node")).drop("own")
    nodes = {len(heavy): left}
    spans = {d: float(total[d] or 0) for d in dims}
    while any(k > 1 for k in nodes.values()):
        open_nodes = members.where(F.col("node") >= len(heavy))
        cuts = _cut_level(spark, open_nodes, nodes, dims, spans)
        rows = [(node, *cut, node + nodes[node] // 2) for node, cut in cuts.items()]
        nodes = {n: k for node, k0 in nodes.items() for n, k in ([(node, 1)] if k0 == 1 else [(node, k0 // 2), (node + k0 // 2, k0 - k0 // 2)])}
        if not rows:
            break
        splits = spark.createDataFrame(rows, "node int, dim int, low double, width double, at_cell long, at_slice long, right int")
        cell, slice_ = _cell(dims), F.floor(F.col("t") * CELLS)
        beyond = (cell > F.col("at_cell")) | ((cell == F.col("at_cell")) & (slice_ >= F.col("at_slice")))
        members = (members.join(F.broadcast(splits), "node", "left")
                   .withColumn("node", F.when(F.col("dim").isNotNull() & beyond, F.col("right")).otherwise(F.col("node")))
                   .drop("dim", "low", "width", "at_cell", "at_slice", "right"))
    return members.withColumnRenamed("node", "shard")


def shard_rows(docs: DataFrame, shards: int | None = 40, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text",
               dimensions: Mapping[str, Column] | None = None, overhead: int = 16, rows_per_bucket: int = 1 << 16) -> DataFrame:
    """Per row: ``id_col``, size, text_crc32, digest, shard, slot.

    ``target_bytes`` instead of ``shards`` makes as many shards as that takes.  A null
    text counts as empty (CRC 0).  Equal texts, so repeated rows too, share a shard; their
    ids and other columns do not matter but for the least id.  Null ids count as 0 in the
    tree.  Slots number the rows of a shard from 0 without gaps; in buckets of about
    ``rows_per_bucket`` rows, so no task holds a shard.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    stage = Stage(spark, "shards")
    dims = dict(dimensions or document_dimensions(id_col, text_col))
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = stage.put(docs.select(
        F.col(id_col).alias("_id"), (F.octet_length(text) + F.lit(overhead)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("digest"), *[c.cast("double").alias(f"d_{d}") for d, c in dims.items()]), "sizes")
    names = [f"d_{d}" for d in dims]
    groups = sized.groupBy("digest").agg(F.sum("size").alias("w"), *[F.min(d).alias(d) for d in names])
    u = F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("double") / F.lit(float(1 << 48))
    groups = stage.put(groups.withColumn("t", u), "groups")
    if target_bytes is not None:
        total = sized.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    placed = shard_groups(groups, names, shards).select("digest", "shard")
    buckets = max(1, -(-sized.count() // (shards * rows_per_bucket)))
    rows = sized.drop(*names).join(placed, "digest").withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets)))
    rows = stage.put(rows, "rows")
    stage.drop("sizes", "groups")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
               .withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    inside = Window.partitionBy("shard", "bucket").orderBy("_id", "text_crc32")
    numbered = rows.withColumn("place", F.row_number().over(inside)).join(offsets, ["shard", "bucket"])
    return numbered.select(F.col("_id").alias(id_col), "size", "text_crc32", "digest", "shard", (F.col("offset") + F.col("place") - 1).alias("slot"))


def free_name(taken: Sequence[str], name: str) -> str:
    """``name``, or ``name`` and the first number that makes it none of ``taken`` (whatever the case)."""
    low = {c.lower() for c in taken}
    return next(x for x in (name, *(f"{name}_{k}" for k in range(1, len(low) + 2))) if x.lower() not in low)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Write the documents below ``path``, one folder per shard, and return the shard table.

    All columns are written as they are.  The folders are named by ``shard``, or by
    ``shard_1`` and so on where the documents have a column of that name.  Null and equal
    texts, null and repeated ids are placed as in :func:`shard_rows`; an empty table
    writes no folder.
    """
    stage = Stage(docs.sparkSession, "shard-table")
    placed = stage.put(shard_rows(docs, id_col=id_col, text_col=text_col, **options), "table")
    shard = free_name(docs.columns, "shard")
    key = free_name([*docs.columns, shard], "digest")
    by_text = placed.select(F.col("digest").alias(key), F.col("shard").alias(shard)).distinct()
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    docs.withColumn(key, digest).join(by_text, key).drop(key).write.partitionBy(shard).parquet(path)
    return placed
