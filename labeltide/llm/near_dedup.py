"""Operator 4: near-duplicate documents by SuperMinHash signatures, banding, verification and grouping.

1. Each document becomes the set of its distinct word shingles.  Documents with
   equal sets form a class, a node of the graph under a number of its own; ids
   come in at the end only.
2. A class gets a SuperMinHash signature: every shingle deals the positions
   0..m-1 out in an order of its own, one position per level, and offers
   ``level + fraction`` there.  A document is finished as soon as every position
   holds a value below the next level, which for most texts is after a few of
   the m levels.
3. Classes that agree in a whole band of the signature share a bucket.  Each
   member is linked to its bucket's smallest member if their full sets pass.
   The sets of the classes that share a bucket are hashed from the texts once
   more; a bit field of fixed size keeps nearly all others from being sent.
4. Buckets whose members still lie in different components are compared in full,
   in blocks of bounded size.  First by signature: members in different
   components that agree well enough are joined to families, each block emitting
   a forest of links rather than its pairs.  Then the members of a family are
   compared on their full sets, again in blocks, and the links that join
   components are emitted.  The largest component of a bucket or family is not
   compared with itself.  So no bucket is capped, and none emits all its pairs.
5. Components by star contraction; the smallest id of each is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltide.llm.common import Stage
from labeltide.llm.components import components
from labeltide.llm.wordhash import WordHasher, distinct_sets, mix, shingles, text_chunks

_LIST_LEVELS = 8
_EMPTY = np.uint64((1 << 64) - 1)


def superminhash(values: np.ndarray, doc: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """``n_docs`` x ``m`` signatures; ``values[i]`` is an element of document ``doc[i]``.

    An entry packs the level (high 32 bits) and the fraction (low 32 bits).  The
    order in which an element deals positions is a Fisher-Yates shuffle; its
    first levels keep only the swaps made, later ones (short documents) the
    whole permutation.
    """
    out = np.full(n_docs * m, _EMPTY, dtype=np.uint64)
    swapped: list[tuple[np.ndarray, np.ndarray]] = []  # per level: the slot that was overwritten, and by what
    order: np.ndarray | None = None
    low = np.uint64(0xFFFFFFFF)
    for level in range(m):
        draw = mix(values + np.uint64((level * 0xA0761D6478BD642F) & ((1 << 64) - 1)))
        slot = (((draw & low) * np.uint64(m - level)) >> np.uint64(32)).astype(np.int16) + np.int16(level)
        if level < _LIST_LEVELS:
            here, place = np.full(len(slot), level, dtype=np.int16), slot.copy()
            for past, held in swapped:
                np.copyto(here, held, where=past == level)
                np.copyto(place, held, where=past == slot)
            swapped.append((slot, here))
        else:
            if order is None:
                order = np.tile(np.arange(m, dtype=np.int16), (len(values), 1))
                rows = np.arange(len(values))
                for past, held in swapped:
                    order[rows, past] = held
            rows = np.arange(len(values))
            place = order[rows, slot]
            order[rows, slot] = order[:, level]
        offer = np.uint64(level << 32) | (draw >> np.uint64(32))
        np.minimum.at(out, doc * m + place, offer)
        open_doc = out.reshape(n_docs, m).max(axis=1) >= np.uint64((level + 1) << 32)
        keep = open_doc[doc]
        if not keep.all():
            values, doc = values[keep], doc[keep]
            swapped = [(a[keep], b[keep]) for a, b in swapped] if order is None else []
            order = order[keep] if order is not None else None
        if not len(values):
            break
    return out.reshape(n_docs, m)


def _fixed_binary(rows: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column from a byte matrix; rows with size 0 are empty."""
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    data = np.ascontiguousarray(rows[sizes > 0]).tobytes()
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _signer(size: int, bands: int, rows: int):
    m = bands * rows
    factors = mix(np.arange(1, rows + 1, dtype=np.uint64)) | np.uint64(1)
    band_no = mix(np.arange(bands, dtype=np.uint64) + np.uint64(1 << 20))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(2)):
                hashes, _, _, bounds = hasher.words(data, offsets)
                flat, sets = distinct_sets(*shingles(hashes, bounds, size))
                counts, n = np.diff(sets), end - first
                filled = counts > 0
                prints = np.zeros((2, n), dtype=np.uint64)
                for k, salt in enumerate((0x5851F42D4C957F2D, 0x14057B7EF767814F)):
                    sums = np.zeros(len(flat) + 1, dtype=np.uint64)
                    np.cumsum(mix(flat ^ np.uint64(salt)), out=sums[1:])
                    prints[k] = sums[sets[1:]] - sums[sets[:-1]]
                dense = np.cumsum(filled) - 1
                doc = dense[np.repeat(np.arange(n), counts)]
                signature = superminhash(flat, doc, int(filled.sum()), m)
                grouped = signature.reshape(-1, bands, rows)
                hashed = mix((grouped * factors).sum(axis=2, dtype=np.uint64) + band_no).view(np.int64)
                list_offsets = np.concatenate(([0], np.cumsum(np.where(filled, bands, 0)))).astype(np.int32)
                short = np.zeros((n, m), dtype=np.uint8)
                short[filled] = (signature & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, n), batch.column(1).slice(first, n), pa.array(counts.astype(np.int64)),
                    pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(list_offsets), pa.array(hashed.ravel())),
                    _fixed_binary(short, np.where(filled, m, 0)),
                ], names=["id", "tie", "n_shingles", "fp1", "fp2", "bands", "sig"])
    return run


_FIELD_BITS = 27


def _field(keys: DataFrame) -> np.ndarray:
    """A bit field of 2^27 bits (16 MB), whatever the number of ``keys`` (k1), with two bits set for each.

    It reaches the driver as at most 2^21 words; a field that fills up lets more pass, never less.
    """

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.concatenate(_field_bits(batch.column(0).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array((bits >> 6).astype(np.int32)), pa.array((np.uint64(1) << (bits & 63).astype(np.uint64)).view(np.int64))], names=["word", "mask"])

    words = keys.mapInArrow(places, "word int, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    field = np.zeros(1 << (_FIELD_BITS - 6), dtype=np.int64)
    field[words.column("word").to_numpy()] = words.column("mask").to_numpy()
    return field.view(np.uint8)


def _field_bits(k1: np.ndarray) -> list[np.ndarray]:
    u = mix(k1.view(np.uint64))
    return [(u >> np.uint64(64 - _FIELD_BITS)).astype(np.int64), (u & np.uint64((1 << _FIELD_BITS) - 1)).astype(np.int64)]


def _set_maker(size: int, field):
    """(k1, k2, text) to (k1, k2, set): the sorted hashes of the distinct shingles of rows whose key is in the field."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, bits = WordHasher(), field.value
        for batch in batches:
            places = _field_bits(batch.column(0).to_numpy())
            batch = batch.filter(pa.array(np.all([bits[p >> 3] >> (p & 7) & 1 for p in places], axis=0).astype(bool)))
            for first, end, data, offsets in text_chunks(batch.column(2)):
                hashes, _, _, bounds = hasher.words(data, offsets)
                flat, cuts = distinct_sets(*shingles(hashes, bounds, size))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first),
                                                  pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(flat.view(np.int64)))],
                                                 names=["k1", "k2", "set"])
    return run


def _links(block: pa.Table, low: np.ndarray, high: np.ndarray, agree, joined: str) -> pa.Table:
    """A spanning set of the pairs low x high of different components for which ``agree(i)``, over ``high``, holds with ``low[i]``.

    ``joined`` names the column whose equal values count as connected from the start.
    """
    node, comp = (block.column(c).to_numpy() for c in ("node", "comp"))
    group = np.unique(block.column(joined).to_numpy(), return_inverse=True)[1]
    a, b = [], []
    for i, x in enumerate(low):
        near = high[agree(i) & (comp[high] != comp[x])]
        groups, first = np.unique(group[near], return_index=True)
        new = groups != group[x]
        if new.any():
            b.extend(node[near[first[new]]].tolist())
            a.extend([int(node[x])] * int(new.sum()))
            group[np.isin(group, groups)] = group[x]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _likely(m: int, percent: int, slack: float):
    """Links members in different components whose signatures agree in nearly ``percent``: a superset, as a forest."""
    need = max(0.0, percent / 100 - slack)
    least = int(np.floor(m * (need + (1 - need) / 256)))

    def likely(block: pa.Table) -> pa.Table:
        n = block.column("n").to_numpy()
        sig = np.frombuffer(b"".join(block.column("sig").to_pylist()), dtype=np.uint8).reshape(-1, m)
        low, high = (np.flatnonzero(block.column(c).to_numpy(zero_copy_only=False)) for c in ("is_low", "is_high"))
        sig_high, n_high = sig[high], n[high]

        def agree(i: int) -> np.ndarray:
            x = low[i]
            out = 100 * np.minimum(n_high, n[x]) >= percent * np.maximum(n_high, n[x])
            out[out] = (sig_high[out] == sig[x]).sum(axis=1) >= least
            return out
        return _links(block, low, high, agree, "node")  # all that may have a link, not one of each component
    return likely


def _exact(percent: int, cells: int = 1 << 21):
    """Links members in different components whose full sets pass, as a forest.

    Intersections come from products of membership matrices over the shingles that
    at least two members share, ``cells`` matrix cells at a time.
    """

    def exact(block: pa.Table) -> pa.Table:
        column = block.column("set").combine_chunks()
        n = np.diff(column.offsets.to_numpy()).astype(np.int64)
        low, high = (np.flatnonzero(block.column(c).to_numpy(zero_copy_only=False)) for c in ("is_low", "is_high"))
        value, member = column.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)
        order = np.argsort(value, kind="stable")
        value, member = value[order], member[order]
        code = np.concatenate(([0], np.cumsum(value[1:] != value[:-1])))
        counts = np.bincount(code)
        shared = counts[code] > 1
        code, member = (np.cumsum(counts > 1) - 1)[code[shared]], member[shared]
        joint = np.zeros((len(low), len(high)))
        width = max(1, cells // len(n))
        for start in range(0, int(code[-1]) + 1 if len(code) else 0, width):
            a, b = np.searchsorted(code, (start, start + width))
            matrix = np.zeros((len(n), width), dtype=np.float32)
            matrix[member[a:b], code[a:b] - start] = 1
            joint += matrix[low] @ matrix[high].T
        return _links(block, low, high, lambda i: 100.0 * joint[i] >= percent * (n[low[i]] + n[high] - joint[i]), "comp")
    return exact


def _in_blocks(stage: Stage, members: DataFrame, key: str, block: int, name: str) -> DataFrame:
    """``members`` (``key``, node, comp, ...) dealt to pairs of blocks of their key's members, about ``block`` to a block.

    Every two members in different components meet.  The low blocks hold the members
    outside the key's largest component, the high blocks all of them.
    """
    comps = members.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("c"))
    main = comps.groupBy(key).agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("all"))
    main = stage.put(main.select(key, F.col("m.comp").alias("main"), F.ceil(F.col("all") / block).cast("int").alias("highs"),
                                 F.ceil((F.col("all") - F.col("m.c")) / block).cast("int").alias("lows")).where("lows > 0"), name)
    dealt = members.join(main.hint("merge"), key)
    spread = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
    rest = [c for c in members.columns]
    as_high = dealt.select(*rest, F.explode(F.sequence(F.lit(0), F.col("lows") - 1)).alias("low"), spread("highs").alias("high"),
                           F.lit(False).alias("is_low"), F.lit(True).alias("is_high"))
    as_low = dealt.where("comp != main").select(*rest, spread("lows").alias("low"), F.explode(F.sequence(F.lit(0), F.col("highs") - 1)).alias("high"),
                                                F.lit(True).alias("is_low"), F.lit(False).alias("is_high"))
    return as_high.union(as_low)


def _keys(id_col, tie_col) -> list:
    """Two 64-bit hashes that name a row by id and tie."""
    return [F.xxhash64(id_col, tie_col).alias("k1"), F.xxhash64(tie_col, F.lit(1), id_col).alias("k2")]


def _passing(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of ``edges`` (a, b) whose full sets (node, set) pass."""
    # Neither side has a bounded size: sort-merge joins, which adaptive execution can split.
    joint = F.size(F.array_intersect("set_a", "set_b"))
    return (edges.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")).hint("merge"), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")).hint("merge"), "b")
            .withColumn("joint", joint)
            .where(100 * F.col("joint") >= percent * (F.size("set_a") + F.size("set_b") - F.col("joint"))).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5,
                    percent: int = 80, bands: int = 42, rows: int = 6, block: int = 1024,
                    slack: float = 0.15, row_col: str | None = None) -> DataFrame:
    """Every row's set size, component and whether it is its component's smallest id.

    ``size`` words per shingle; documents are linked if ``100 * |A and B| >= percent * |A or B|``.
    ``bands`` x ``rows`` signature positions: a pair at 0.8 shares no band with probability
    (1 - 0.8^6)^42, 3 in a million.  ``slack`` is how far below the threshold a signature's
    estimate may lie for a pair of an unresolved bucket to be checked (six standard deviations).

    Returns ``id_col``, n_shingles, component_id, kept, one row per input row.
    Null or empty texts, and texts without a word, have the empty set and are linked with
    nothing.  Every row is linked by its own text: rows that share an id are not linked for
    that.  component_id is the smallest id in the component, null only if it holds no id; a
    null id is never smaller than another.  ``kept`` tells whether the row's id is that id.
    Other columns are ignored.  An empty table gives no rows.

    With ``row_col``, a column of distinct long numbers, that column comes too, with
    ``stays``: true for exactly one row of each component, one with the component's id.
    """
    m, spark = bands * rows, docs.sparkSession
    stage = Stage(spark, "near-dedup")
    tie = F.col(row_col).cast("long") if row_col else F.xxhash64(F.col(text_col))
    docs = docs.select(F.col(id_col).cast("long").alias("id"), tie.alias("tie"), F.col(text_col).alias("text"))
    signed = stage.put(docs.mapInArrow(
        _signer(size, bands, rows),
        "id long, tie long, n_shingles long, fp1 long, fp2 long, bands array<long>, sig binary"), "signed")

    same = ["fp1", "fp2", "n_shingles"]
    first_row = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "tie")).alias("rep")
    classes = signed.where("n_shingles > 0").groupBy(*same).agg(first_row).withColumn("node", F.monotonically_increasing_id())
    classes = stage.put(classes, "classes")
    members = signed.select("id", "tie", *same).join(classes.select(*same, "node").hint("merge"), same, "left")
    named = [F.col("id").eqNullSafe(F.col("rep.id")), F.col("tie") == F.col("rep.tie")]
    heads = signed.join(classes.hint("merge"), same).where(named[0] & named[1])
    heads = heads.dropDuplicates(same).select("node", F.col("n_shingles").alias("n"), "bands", "sig", *_keys("id", "tie"))
    heads = stage.put(heads, "heads")

    banded = heads.select("node", F.explode("bands").alias("bucket"))
    leaders = banded.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("top")).where("leader < top")
    shared = stage.put(banded.join(leaders.select("bucket", "leader"), "bucket"), "shared")
    wanted = heads.select("node", "k1", "k2").join(shared.select("node").distinct().hint("merge"), "node", "left_semi")
    wanted = stage.put(wanted, "wanted")
    field = spark.sparkContext.broadcast(_field(wanted.select("k1")))
    made = docs.select(*_keys("id", "tie"), "text").mapInArrow(_set_maker(size, field), "k1 long, k2 long, set array<long>")
    sets = made.dropDuplicates(["k1", "k2"]).join(wanted.hint("merge"), ["k1", "k2"]).select("node", "set")
    sets = stage.put(sets, "sets")
    field.unpersist()
    first = shared.where("node != leader").select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct()
    links = stage.put(_passing(first, sets, percent), "links")
    roots = components(stage, links, "round1")

    placed = (shared.join(roots.hint("merge"), F.col("node") == F.col("u"), "left")
              .select("bucket", "node", F.coalesce("v", "node").alias("comp")))
    split = (placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members"))
             .where("lo < hi and members > 2").select("bucket"))
    open_ = placed.join(split, "bucket", "left_semi").join(heads.select("node", "n", "sig").hint("merge"), "node")
    near = (_in_blocks(stage, open_, "bucket", block, "buckets").repartition("bucket", "low", "high").groupBy("bucket", "low", "high")
            .applyInArrow(_likely(m, percent, slack), "a long, b long"))
    family = components(stage, stage.put(near.distinct(), "near"), "families")
    family = stage.put(family.union(family.select(F.col("v").alias("u"), "v").distinct()), "family")
    if not family.isEmpty():
        relatives = (sets.join(family.hint("merge"), F.col("u") == F.col("node"))
                     .join(roots.select(F.col("u").alias("at"), F.col("v").alias("root")).hint("merge"), F.col("u") == F.col("at"), "left")
                     .select(F.col("v").alias("family"), "node", F.coalesce("root", "node").alias("comp"), "set"))
        more = (_in_blocks(stage, stage.put(relatives, "relatives"), "family", block, "kin").repartition("family", "low", "high").groupBy("family", "low", "high")
                .applyInArrow(_exact(percent), "a long, b long"))
        links = stage.put(links.union(more.distinct()), "links-2")
        roots = components(stage, links, "round2")
    rooted = (classes.select("node", "rep").join(roots.hint("merge"), F.col("node") == F.col("u"), "left")
              .select(F.col("node").alias("of"), "rep", F.coalesce("v", "node").alias("root")))
    least = stage.put(rooted.groupBy("root").agg(F.min("rep").alias("least")), "least")
    found = rooted.join(least.hint("merge"), "root").select("of", "least")
    stage.drop("heads", "shared", "wanted", "sets", "links", "buckets", "near", "family", "relatives", "kin", "links-2")
    component = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least.id"))
    out = members.join(found.hint("merge"), F.col("node") == F.col("of"), "left")
    stays = F.col("node").isNull() | (F.col("tie") == F.col("least.tie"))
    return out.select(F.col("id").alias(id_col), *([F.col("tie").alias(row_col), stays.alias("stays")] if row_col else []), "n_shingles",
                      component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
