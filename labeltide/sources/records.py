"""Records of delimited files whose quoted fields may hold line ends, read in parallel.

A line's end is a record's end unless it lies inside a quoted field, which depends on all
that stands before it in the file.  So files are read by lines, in splits:

1. Each split is scanned once for both cases, starting outside and inside a quoted field:
   in which state it ends, how many records start in it, and its first record.
2. Over this table, one row per split, a prefix composition of the splits' state changes
   gives the state each split really starts in, and running totals number its records.
3. Each split is cut into records.  A record that spans splits leaves a fragment in each;
   the fragments, at most two per split, are joined.

Quotes count where the parser of the fields would heed them: a quote opens a field only as
its first character, a doubled one stands for itself, and what follows a closing quote up
to the separator belongs to the field.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

QUOTE = 0x22


def state_after(line: bytes, inside: bool, sep: bytes) -> bool:
    """Whether a quoted field is open after ``line``, which starts inside one or not."""
    at = 0
    while True:
        if inside:
            end = line.find(b'"', at)
            if end < 0:
                return True
            if line[end + 1:end + 2] == b'"':
                at = end + 2
                continue
            at = line.find(sep, end + 1)
        elif line[at:at + 1] == b'"':
            at, inside = at + 1, True
            continue
        else:
            if line.find(b'"', at) < 0:
                return False
            at = line.find(sep, at)
        if at < 0:
            return False
        at, inside = at + len(sep), False


def _runs(batches: Iterator) -> Iterator[tuple[object, list[bytes], np.ndarray, bool]]:
    """((file, block, row of the batch), lines, places of lines with a quote, whether a new split begins) per split and batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    known = None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, block = (batch.column(c).to_pylist() for c in ("__file", "__block"))
        lines = batch.column("value").cast(pa.large_binary())
        quoted = pc.match_substring(lines, b'"').to_numpy(zero_copy_only=False).astype(bool)
        lines = lines.to_pylist()
        first = 0
        for end in range(1, batch.num_rows + 1):
            if end == batch.num_rows or file[end] != file[first] or block[end] != block[first]:
                key = (file[first], block[first])
                yield (*key, batch, first), lines[first:end], np.flatnonzero(quoted[first:end]), key != known
                known, first = key, end


def _record_text(lines: list[bytes], encoding: str) -> str:
    data = b"\n".join(x[:-1] if x.endswith(b"\r") else x for x in lines)
    return data.decode(encoding, "replace")


def _scanner(sep: bytes, encoding: str):
    """One row per split: for both starting states, where it ends and how many records start in it; its first record."""
    import pyarrow as pa

    def rows(found: dict) -> pa.RecordBatch:
        head = _record_text(found["head"], encoding) if found["head"] is not None else None
        return pa.RecordBatch.from_arrays(
            [pa.array([found[k]]) for k in ("file", "block", "out_end", "in_end", "out_starts", "in_starts")] + [pa.array([head], pa.string()), found["extra"]],
            names=["file", "block", "out_end", "in_end", "out_starts", "in_starts", "head", "extra"])

    def blank(line: bytes) -> bool:
        return line in (b"", b"\r")

    def run(batches: Iterator) -> Iterator:
        found = None
        for (file, block, batch, first), lines, quoted, new in _runs(batches):
            if new:
                if found:
                    yield rows(found)
                found = {"file": file, "block": block, "out_end": False, "in_end": True, "out_starts": 0, "in_starts": 0, "head": None,
                         "head_open": False, "extra": batch.column("__extra").slice(first, 1)}
            solid = np.array([not blank(x) for x in lines])
            for name in ("out", "in"):
                state, starts, last = found[f"{name}_end"], 0, 0
                for at in (*quoted.tolist(), len(lines)):
                    if not state:
                        starts += int(solid[last:at].sum())
                    if at < len(lines):
                        starts += not state  # a line with a quote is not blank
                        state, last = state_after(lines[at], state, sep), at + 1
                found[f"{name}_end"], found[f"{name}_starts"] = state, found[f"{name}_starts"] + starts
            if found["head"] is None or found["head_open"]:
                for line in lines:
                    if found["head"] is None:
                        if blank(line):
                            continue
                        found["head"] = []
                    found["head"].append(line)
                    found["head_open"] = state_after(line, found["head_open"], sep)
                    if not found["head_open"]:
                        break
        if found:
            yield rows(found)
    return run


def _cutter(sep: bytes, encoding: str):
    """Each split's records: number of the record start in the split (-1: begun before), text, and whether it goes on in the next split."""
    import pyarrow as pa

    def run(batches: Iterator) -> Iterator:
        place = ("", 0)
        number, inside, held = -1, False, []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            file, block, seq, text, more = zip(*rows)
            return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(block, pa.int64()), pa.array(seq, pa.int64()),
                                               pa.array(text, pa.string()), pa.array(more, pa.bool_())], names=["file", "block", "seq", "text", "more"])

        for (file, block, batch, first), lines, quoted, new in _runs(batches):
            rows = []
            if new:
                if held:
                    rows.append((*place, number, _record_text(held, encoding), True))
                place, number, held = (file, block), -1, []
                inside = batch.column("__inside")[first].as_py()
            states, marks = inside, set(quoted.tolist())
            for k, line in enumerate(lines):
                if not states:
                    if line in (b"", b"\r"):
                        continue
                    number += 1
                if k in marks:
                    states = state_after(line, states, sep)
                held.append(line)
                if not states:
                    rows.append((*place, number, _record_text(held, encoding), False))
                    held = []
            inside = states
            if rows:
                yield batch_of(rows)
        if held:
            yield batch_of([(*place, number, _record_text(held, encoding), True)])
    return run


def _split_table(found: DataFrame, drop_first: bool) -> DataFrame:
    """One row per split: file, block, inside and ends (the state it starts and ends in), offset and skipped (of its records' numbers), head, extra."""
    in_file = Window.partitionBy("file").orderBy("block")
    fixed = F.col("out_end") == F.col("in_end")
    flips = F.sum((F.col("out_end") & ~F.col("in_end")).cast("long")).over(in_file)
    # After the last split that fixes the state, only flips change it; a file starts outside.
    base = F.last(F.when(fixed, (F.col("out_end").cast("long") + F.col("flips")) % 2), ignorenulls=True).over(in_file)
    ended = found.withColumn("flips", flips).withColumn("base", F.coalesce(base, F.lit(0)))
    ended = ended.withColumn("ends", (F.col("base") + F.col("flips")) % 2 == 1)
    started = (ended.withColumn("inside", F.coalesce(F.lag("ends").over(in_file), F.lit(False)))
               .withColumn("starts", F.when(F.col("inside"), F.col("in_starts")).otherwise(F.col("out_starts"))))
    earlier = F.coalesce(F.sum("starts").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    started = started.withColumn("holds_first", (F.col("starts") > 0) & (earlier == 0))
    started = started.withColumn("skipped", (F.col("holds_first") & F.lit(drop_first)).cast("long"))
    over_all = Window.orderBy("extra.__part", "file", "block").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("starts") - F.col("skipped")).over(over_all), F.lit(0))
    return stored(started.withColumn("offset", offset).select("file", "block", "inside", "ends", "holds_first", "skipped", "offset", "head", "extra"), "split-states")


def _lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(value, __file, __block, __extra): the lines of all files, each file split in order; ``__extra`` is its path's place and partition folders."""
    lines = None
    for k, path in enumerate(paths):
        raw = spark.read.option("lineSep", "\n").text(path)
        more = [c for c in raw.columns if c != "value"]
        raw = raw.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"),
                         F.struct(F.lit(k).alias("__part"), *[F.col(c).cast("string").alias(c) for c in more]).alias("__extra"))
        if lines is not None and raw.schema["__extra"].dataType != lines.schema["__extra"].dataType:
            raise ValueError(f"{path} has other partition folders than {paths[0]}")
        lines = raw if lines is None else lines.unionByName(raw)
    return lines


def quoted_records(spark: SparkSession, paths: Sequence[str], sep: str = ",", encoding: str = "UTF-8",
                   drop_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, heads): file, part (place of its path), ord, text and the partition columns of every record; file and first record of every file.

    ``ord`` runs from 0 over all records, in the order of ``paths``, file names and lines.
    With ``drop_first`` the first record of each file (its header) is neither numbered nor
    returned.  Empty lines outside quotes are no records.  Line ends are ``\\n`` or
    ``\\r\\n``, and come back as ``\\n`` inside fields; undecodable bytes become U+FFFD.  A
    quote that never closes makes the rest of its file one record.
    """
    lines = _lines(spark, paths)
    extra = lines.schema["__extra"].dataType
    shape = f"file string, block long, out_end boolean, in_end boolean, out_starts long, in_starts long, head string, extra {extra.simpleString()}"
    splits = _split_table(stored(lines.mapInArrow(_scanner(sep.encode(encoding), encoding), shape), "splits"), drop_first)
    # One row per file split, as many as the scan has tasks at most: the side that keeps the lines in order.
    states = F.broadcast(splits.select(F.col("file").alias("__of"), F.col("block").alias("__at"), F.col("inside").alias("__inside")))
    fed = lines.join(states, (F.col("__file") == F.col("__of")) & (F.col("__block") == F.col("__at"))).select("value", "__file", "__block", "__inside")
    cut = fed.mapInArrow(_cutter(sep.encode(encoding), encoding), "file string, block long, seq long, text string, more boolean")
    whole = cut.where("seq >= 0 and not more").drop("more")
    if not splits.where("ends").isEmpty():
        pieces = stored(cut.where("seq < 0 or more"), "fragments")
        order = Window.partitionBy("file").orderBy("block", "seq")
        owner = F.last(F.when(F.col("seq") >= 0, F.struct("block", "seq")), ignorenulls=True).over(order)
        joined = (pieces.withColumn("owner", owner).groupBy("file", "owner")
                  .agg(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))).alias("t"))
                  .select("file", "owner.block", "owner.seq", F.array_join(F.transform("t", lambda x: x["text"]), "\n").alias("text")))
        whole = whole.unionByName(joined)
    return _placed(whole, splits)


def _placed(whole: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, heads) of ``whole`` (file, block, seq, text), numbered by the table of splits."""
    numbers = F.broadcast(splits.select(F.col("file").alias("__of"), F.col("block").alias("__at"), "skipped", "offset", "extra"))
    placed = whole.join(numbers, (F.col("file") == F.col("__of")) & (F.col("block") == F.col("__at"))).where(F.col("seq") >= F.col("skipped"))
    own = [F.col(f"extra.`{f.name}`").alias(f.name) for f in splits.schema["extra"].dataType.fields if f.name != "__part"]
    records = placed.select("file", F.col("extra.__part").alias("part"), (F.col("offset") + F.col("seq") - F.col("skipped")).alias("ord"), "text", *own)
    return records, splits.where("holds_first").select("file", "extra.__part", "head")


def line_records(spark: SparkSession, paths: Sequence[str], encoding: str = "UTF-8", drop_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """As :func:`quoted_records`, for files whose fields hold no line ends: every line that is not empty is a record."""
    text = F.col("value").cast("string") if encoding.upper().replace("-", "") == "UTF8" else F.decode("value", encoding)
    lines = _lines(spark, paths).withColumn("text", F.regexp_replace(text, "\\r$", "")).where("text <> ''").withColumn("__serial", F.monotonically_increasing_id())
    splits = lines.groupBy(F.col("__file").alias("file"), F.col("__block").alias("block")).agg(
        F.lit(False).alias("out_end"), F.lit(True).alias("in_end"), F.count(F.lit(1)).alias("out_starts"), F.lit(0).cast("long").alias("in_starts"),
        F.min_by("text", "__serial").alias("head"), F.first("__extra").alias("extra"), F.min("__serial").alias("first"))
    splits = stored(splits, "splits")
    states = _split_table(splits.drop("first"), drop_first)
    firsts = F.broadcast(splits.select(F.col("file").alias("__of"), F.col("block").alias("__at"), "first"))
    numbered = lines.join(firsts, (F.col("__file") == F.col("__of")) & (F.col("__block") == F.col("__at")))
    return _placed(numbered.select(F.col("__file").alias("file"), F.col("__block").alias("block"), (F.col("__serial") - F.col("first")).alias("seq"), "text"), states)


def header_names(head: str, sep: str) -> list[str]:
    """Column names of a header record: a missing one is ``_c`` and its place, a repeated one gets its place added."""
    import csv
    import io

    csv.field_size_limit(max(csv.field_size_limit(), len(head) + 1))
    names = [x or f"_c{k}" for k, x in enumerate(next(csv.reader(io.StringIO(re.sub("^﻿", "", head), newline=""), delimiter=sep)))]
    low = [x.lower() for x in names]
    return [f"{x}{k}" if low.count(x.lower()) > 1 else x for k, x in enumerate(names)]
