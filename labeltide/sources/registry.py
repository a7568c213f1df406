"""Dataset registry and the harmonising loader.

Every corpus is read into one schema::

    row_ord BIGINT, id STRING, text STRING, label STRING, task STRING, source STRING

``load`` returns (train, dev, test) DataFrames; a dataset without a test
split returns an empty frame of the same schema.  Paths are arguments, the
registry only says how each corpus is laid out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prepare import dedup_rows, forward_fill, holdout_split, split_frames, union_datasets
from .delimited import LATIN1, read_delimited, read_gold

HARMONISED = ("row_ord BIGINT, id STRING, text STRING, label STRING, "
              "task STRING, source STRING")


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    text_col: str
    label_cols: dict[str, str]           # task name -> label column
    id_col: str | None = None
    sep: str = ","
    encoding: str = "UTF-8"
    forward_fill: bool = False
    test_sep: str = ","
    test_header: bool = True
    test_names: tuple[str, ...] = ()
    test_id_col: str | None = None
    classes: dict[str, tuple[str, ...]] = field(default_factory=dict)


# Corpus layouts (text column, label columns per task, id column,
# delimiter, encoding) and the label sets named for them.
REGISTRY: dict[str, DatasetSpec] = {
    "hasoc": DatasetSpec(
        "hasoc", "text", {"1": "task_1", "2": "task_2"}, id_col="_id",
        test_id_col="_id",
        classes={"1": ("NOT", "HOF"), "2": ("NONE", "PRFN", "OFFN", "HATE")}),
    "trol": DatasetSpec("trol", "Text", {"A": "Sub-task A"},
                        classes={"A": ("NAG", "CAG", "OAG")}),
    "sema": DatasetSpec("sema", "text", {"A": "HS"}, sep="\t", encoding=LATIN1,
                        forward_fill=True),
    "semb": DatasetSpec("semb", "text", {"B": "HS"}, sep="\t", encoding=LATIN1,
                        forward_fill=True),
    "hos": DatasetSpec("hos", "tweet", {"1": "hate_speech"}),
    "olid": DatasetSpec(
        "olid", "tweet", {"a": "subtask_a", "b": "subtask_b", "c": "subtask_c"},
        id_col="id", test_sep="\t", test_id_col="id",
        classes={"a": ("NOT", "OFF"), "b": ("TIN", "UNT"), "c": ("GRP", "IND", "OTH")}),
    "pcl": DatasetSpec(
        "pcl", "text", {"1": "label"}, test_sep="\t", test_header=False,
        test_names=("tno", "art_id", "keyword", "country_code", "text"),
        test_id_col="art_id", classes={"1": ("0", "1")}),
}


def spec_for(dataset: str) -> DatasetSpec:
    try:
        return REGISTRY[dataset]
    except KeyError:
        raise ValueError(f"unknown dataset {dataset!r}; known: {sorted(REGISTRY)}") from None


def harmonise(df: DataFrame, spec: DatasetSpec, task: str, source: str | Column,
              text_col: str | None = None, id_col: str | None = None) -> DataFrame:
    """Select and rename one corpus frame into the harmonised schema."""
    return _harmonised(df, spec, {task: "label"}, source, text_col, id_col, F.lit(task).alias("task"))


def _harmonised(df: DataFrame, spec: DatasetSpec, label_names: dict[str, str], source: str | Column,
                text_col: str | None, id_col: str | None, *more: Column) -> DataFrame:
    """One corpus frame with the label of each task under its name in ``label_names``."""
    text_col = text_col or spec.text_col
    id_col = id_col if id_col is not None else spec.id_col

    def label(task: str) -> Column:
        label_col = spec.label_cols.get(task)
        return F.col(label_col).cast("string") if label_col and label_col in df.columns else F.lit(None).cast("string")

    return df.select(
        F.col("row_ord").cast("long").alias("row_ord"),
        (F.col(id_col).cast("string") if id_col and id_col in df.columns
         else F.col("row_ord").cast("string")).alias("id"),
        F.col(text_col).cast("string").alias("text"),
        *[label(task).alias(name) for task, name in label_names.items()],
        *more,
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
    )


def _read_split(spark: SparkSession, spec: DatasetSpec, paths: list[str], kind: str) -> DataFrame:
    """The rows of all ``paths``, numbered through, with the place of their path as ``__part``: one scan numbers all files."""
    if kind == "test" and not spec.test_header:
        return read_delimited(spark, paths, sep=spec.test_sep, header=False, names=list(spec.test_names), part_col="__part")
    return read_delimited(spark, paths, sep=spec.test_sep if kind == "test" else spec.sep, encoding=spec.encoding, part_col="__part")


def _combined(spark: SparkSession, spec: DatasetSpec, kind: str, parts: list[tuple[str, str]]) -> DataFrame:
    """The raw rows of ``parts`` (path, source) in one order, full-row duplicates dropped after the union.

    The first occurrence stays, in the order of parts and rows; ``row_ord``
    numbers all parts through, so it is a unique key of the result.
    """
    united = _read_split(spark, spec, [path for path, _ in parts], kind)
    if spec.forward_fill:
        # Each path is filled by itself: nothing is carried from one corpus file to the next.
        own = [c for c in united.columns if c not in ("row_ord", "__part")]
        frames = [forward_fill(united.where(F.col("__part") == k), own, "row_ord") for k in range(len(parts))]
        united = frames[0] if len(frames) == 1 else union_datasets(frames, rank_col=None)
    # Rows are numbered through all paths in their order, so the first row is of the first path.
    first = dedup_rows(united, "row_ord", along=["__part"])
    names = F.array(*[F.lit(source) for _, source in parts])
    return first.withColumn("source", F.get(names, F.col("__part").cast("int"))).drop("__part")


def load(spark: SparkSession, dataset: str, paths: dict[str, str | list[str]],
         task: str | None = None, augment: bool = False, dev_frac: float | None = None
         ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Read a registered corpus into harmonised (train, dev, test).

    ``paths`` keys: ``train``, ``dev``, optional ``test``, optional ``augment``
    (extra training rows, read after the others when ``augment=True``).  Lists of
    paths are combined datasets; duplicates are dropped over all files of a
    split, the position of the file is kept in ``source``.  With ``dev_frac``
    there is no ``dev`` path: that share of the training rows (before any
    augmentation) is held out.  ``row_ord`` is unique in each split and so is
    ``id`` where the corpus has no id column of its own.
    """
    spec = spec_for(dataset)
    task = task or next(iter(spec.label_cols))
    if task not in spec.label_cols:
        raise ValueError(f"dataset {dataset!r} has no task {task!r}")
    for key in ("train", "dev") if dev_frac is None else ("train",):
        if key not in paths:
            raise ValueError(f"missing path for {key}")
    if dev_frac is not None and "dev" in paths:
        raise ValueError("give either a dev path or dev_frac")
    if dev_frac is None and paths["train"] == paths["dev"]:
        raise ValueError("train and dev paths must differ")
    if augment and "augment" not in paths:
        raise ValueError("augment=True needs an 'augment' path")

    def listed(key: str) -> list[str]:
        return [paths[key]] if isinstance(paths[key], str) else list(paths[key])

    def one(kind: str, parts: list[tuple[str, str]]) -> DataFrame:
        rows = _combined(spark, spec, kind, parts)
        return harmonise(rows, spec, task, F.col("source"), id_col=spec.test_id_col if kind == "test" else None)

    def parts_of(kind: str) -> list[tuple[str, str]]:
        return [(p, f"{dataset}:{kind}:{i}") for i, p in enumerate(listed(kind))]

    base = parts_of("train")
    extra = [(p, f"{dataset}:augment") for p in listed("augment")] if augment else []
    train = one("train", base + extra)
    if dev_frac is None:
        dev = one("dev", parts_of("dev"))
    else:
        own = F.col("source") != f"{dataset}:augment"
        kept, dev = split_frames(holdout_split(train.where(own), dev_frac, "row_ord"))
        train = kept.unionByName(train.where(~own)) if extra else kept
        dev = dev.withColumn("source", F.lit(f"{dataset}:dev:0"))
    test = (one("test", parts_of("test")) if paths.get("test")
            else spark.createDataFrame([], HARMONISED))
    return train, dev, test


def load_tasks(spark: SparkSession, dataset: str, paths: dict[str, str], tasks: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """:func:`load` for several tasks of one corpus, whose files are read once.

    ``paths``: one each for ``train``, ``dev`` and, optionally, ``test``.  Instead of
    ``label`` and ``task`` the rows have the label of each task as ``label_<task>``.
    """
    spec = spec_for(dataset)
    unknown = [t for t in tasks if t not in spec.label_cols]
    if unknown:
        raise ValueError(f"dataset {dataset!r} has no task {unknown[0]!r}")
    for key in ("train", "dev"):
        if key not in paths:
            raise ValueError(f"missing path for {key}")
    if paths["train"] == paths["dev"]:
        raise ValueError("train and dev paths must differ")
    names = {t: f"label_{t}" for t in tasks}

    def one(kind: str) -> DataFrame:
        rows = _combined(spark, spec, kind, [(paths[kind], f"{dataset}:{kind}:0")])
        return _harmonised(rows, spec, names, F.col("source"), None, spec.test_id_col if kind == "test" else None)

    train, dev = one("train"), one("dev")
    return train, dev, one("test") if paths.get("test") else spark.createDataFrame([], train.schema)


def load_gold(spark: SparkSession, path: str, headerless: bool = True, sep: str = ",",
              label_col: str = "label", id_col: str | None = None) -> DataFrame:
    """Gold labels as ``(id STRING, label STRING)``."""
    if headerless:
        return read_gold(spark, path, sep=sep, order_col=None)
    df = read_delimited(spark, path, sep=sep, order_col=None)
    return df.select(F.col(id_col or df.columns[0]).cast("string").alias("id"),
                     F.col(label_col).cast("string").alias("label"))
