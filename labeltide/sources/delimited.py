"""Delimited-file readers.

Columns are read as strings by header name (no schema inference: tweet ids
stay strings and no extra pass over the data), then cast where a spec asks.
Quoted fields may hold line ends and files are split all the same: ``records``
finds the record ends by a scan of the quotes.  ``multiline=False`` leaves that
scan out, for corpora without such fields.  Every file is read by its own header.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .records import header_names, line_records, quoted_records

# The tokens pandas.read_csv turns into missing values by default.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

LATIN1 = "ISO-8859-1"


def normalise_nulls(df: DataFrame, cols: Sequence[str] | None = None,
                    tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """String cells equal to a NULL token become NULL (case-sensitive)."""
    cols = [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and (cols is None or f.name in cols)]
    toks = list(tokens)
    return df.withColumns({c: F.when(F.col(c).isin(toks), F.lit(None)).otherwise(F.col(c))
                           for c in cols}) if cols else df


def _fields(text: Column, names: Sequence[str], sep: str) -> Column:
    """The record's fields by position, as a struct of strings."""
    ddl = ", ".join(f"{n} string" for n in names)
    return F.from_csv(text, ddl, {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})


def _read_records(records: DataFrame, heads: DataFrame, sep: str, header: bool, names: Sequence[str] | None,
                  order_col: str | None, part_col: str | None) -> DataFrame:
    """The fields of ``records``.  Headers differ in few ways, whatever the number of files: each way is a variant."""
    partition = [c for c in records.columns if c not in ("file", "part", "ord", "text")]
    order = [F.col("ord").cast("long").alias(order_col)] if order_col else []
    order += [F.col("part").alias(part_col)] if part_col else []
    if not header:
        places = [f"_{k}" for k in range(len(names))]
        row = records.select(*partition, "part", "ord", _fields(F.col("text"), places, sep).alias("_row"))
        return row.select(*[F.col(f"_row._{k}").alias(n) for k, n in enumerate(names)], *[c for c in partition if c not in names], *order)
    variants = heads.groupBy("head").agg(F.min(F.struct("__part", "file")).alias("first")).orderBy("first").collect()
    layouts = [header_names(v["head"], sep) for v in variants]
    for v, layout in zip(variants, layouts):
        missing = [n for n in names or () if n not in layout and n not in partition]
        if missing:
            raise ValueError(f"columns {missing} not in header of {v['first']['file']}")
    seen = list(dict.fromkeys(n for layout in layouts for n in layout))
    wide = [f"_{k}" for k in range(max((len(x) for x in layouts), default=1))]
    if len(layouts) > 1:
        variant = F.coalesce(*[F.when(F.col("head") == v["head"], F.lit(k)) for k, v in enumerate(variants)])
        of = F.broadcast(heads.select(F.col("file").alias("_of"), variant.alias("_variant")))  # one row per file
        records = records.join(of, F.col("file") == F.col("_of"))
    else:
        records = records.withColumn("_variant", F.lit(0))
    row = records.select(*partition, "part", "ord", "_variant", _fields(F.col("text"), wide, sep).alias("_row"))

    def column(name: str) -> Column:
        own = [F.when(F.col("_variant") == k, F.col(f"_row._{x.index(name)}")) for k, x in enumerate(layouts) if name in x]
        return F.coalesce(*own).alias(name)

    wanted = list(names) if names else [*seen, *[c for c in partition if c not in seen]]
    return row.select(*[column(n) if n in seen else F.col(n) for n in wanted], *order)


def read_delimited(spark: SparkSession, path: str | Sequence[str], sep: str = ",",
                   encoding: str = "UTF-8", header: bool = True,
                   names: Sequence[str] | None = None,
                   types: dict[str, str] | None = None,
                   order_col: str | None = "row_ord",
                   null_tokens: Sequence[str] | None = NULL_TOKENS,
                   multiline: bool = True, part_col: str | None = None) -> DataFrame:
    """Read CSV/TSV into string columns, normalise NULL tokens, cast.

    ``header=False`` requires ``names`` (assigned by position, S4/S5).  With a
    header, every file is read by its own, files are united by column name
    (in the order of first appearance; NULL where a file lacks a column), and
    ``names`` selects columns, which every header must have.  ``order_col`` is
    the row's position over all paths as listed, files by name, and lines;
    ``part_col`` is the place of its path in the list.
    ``multiline=False`` is for files whose fields hold no line ends: their lines
    are cut without the scan.  A value that cannot be cast to its type becomes
    NULL; ``count_cast_losses`` counts them.
    """
    paths = [path] if isinstance(path, str) else list(path)
    if not header and not names:
        raise ValueError("a headerless file needs column names")
    cut = quoted_records(spark, paths, sep, encoding, header) if multiline else line_records(spark, paths, encoding, header)
    df = _read_records(*cut, sep, header, names, order_col, part_col)
    if null_tokens is not None:
        df = normalise_nulls(df, tokens=null_tokens)
    if types:
        df = df.withColumns({c: F.col(c).try_cast(t) for c, t in types.items() if c in df.columns})
    return df


def count_cast_losses(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """One row: per column of ``types``, how many non-NULL strings of ``df`` are no such value."""
    return df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).cast("long").alias(c) for c, t in types.items()])


def read_csv(spark: SparkSession, path, **kw) -> DataFrame:
    """Comma-separated with header."""
    return read_delimited(spark, path, sep=",", **kw)


def read_tsv(spark: SparkSession, path, latin1: bool = False, **kw) -> DataFrame:
    """Tab-separated with header, Latin-1 or UTF-8."""
    return read_delimited(spark, path, sep="\t", encoding=LATIN1 if latin1 else "UTF-8", **kw)


def read_gold(spark: SparkSession, path, sep: str = ",", **kw) -> DataFrame:
    """Headerless gold labels, column 0 the id, column 1 the label."""
    return read_delimited(spark, path, sep=sep, header=False, names=["id", "label"], **kw)


def empty_like(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """A dataset with no test split: no rows, same schema."""
    return spark.createDataFrame([], schema)


def to_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Convert a (single-split) delimited source to splittable Parquet once."""
    df.write.mode(mode).parquet(path)
