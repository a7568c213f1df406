"""Operator 13: near-duplicate documents by 64-bit SimHash and multi-index hashing.

1. A text's fingerprint has a bit set where more than half of the XXH64 hashes of
   its word shingles, repeats included, have it set.
2. Equal fingerprints are one node.  A fingerprint is cut into ``segments`` of
   nearly equal width.  Two fingerprints at distance ``radius`` or less differ in
   some segment by no more than that segment's share of the radius, where the
   shares add up to ``radius - segments + 1`` (a larger distance in every segment
   would add up to more than ``radius``).
3. A table holds every fingerprint under each of its segment values.  Every
   fingerprint asks the table for the values in the Hamming ball of its segment,
   one of each two neighbours asking the other, and complete distances decide.
4. A value that many fingerprints share is compared in blocks of bounded size, of
   which each returns a spanning forest of its links rather than its pairs.
5. Components by star contraction over fingerprints; ids come in at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltide.llm.common import Stage
from labeltide.llm.components import components
from labeltide.llm.wordhash import WordHasher, text_chunks

BITS = 64
_LANES = np.uint64(0x0101010101010101)


def majority_bits(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Per document the 64 bits that more than half of ``hashes[bounds[i]:bounds[i + 1]]`` have set.

    Eight bits are counted at once, one in each byte of a word, over runs of at most 255 hashes.
    """
    counts = np.diff(bounds)
    runs = -(-counts // 255)
    run_doc = np.repeat(np.arange(len(counts)), runs)
    first = np.concatenate(([0], np.cumsum(runs)))
    starts = bounds[run_doc] + 255 * (np.arange(first[-1]) - first[run_doc])
    out = np.zeros(len(counts), dtype=np.uint64)
    if not len(starts):
        return out
    filled = np.flatnonzero(runs)
    for shift in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(shift)) & _LANES, starts)
        ones = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        ones = np.add.reduceat(ones, first[filled], axis=0)
        over = 2 * ones > counts[filled, None]
        for byte in range(8):
            out[filled] |= over[:, byte].astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def _shingle_hashes(hasher: WordHasher, data: np.ndarray, offsets: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each document's shingles (words lower-cased, joined by one space), and their bounds."""
    import xxhash

    solid = ~hasher.space[data]
    first = solid.copy()
    if len(data):
        first[1:] &= ~solid[:-1]
        head = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[head] = solid[head]
    starts = np.flatnonzero(first)
    word = np.cumsum(first)[solid] - 1  # the word of each solid byte
    letters = data[solid]
    letters = np.where((letters >= 65) & (letters <= 90), letters + 32, letters).astype(np.uint8)
    # One space after every word: byte k of word w stands at k + w.
    text = np.full(len(letters) + len(starts), 32, dtype=np.uint8)
    text[np.arange(len(letters)) + word] = letters
    lengths = np.bincount(word, minlength=len(starts)) if len(starts) else np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths) + np.arange(len(starts))
    begins = ends - lengths
    bounds = np.searchsorted(starts, offsets)
    counts = np.diff(bounds)
    n_out = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate(([0], np.cumsum(n_out)))
    doc = np.repeat(np.arange(len(counts)), n_out)
    at = np.arange(out_bounds[-1]) - out_bounds[doc] + bounds[doc]
    last = np.minimum(at + size, bounds[doc + 1]) - 1
    raw = text.tobytes()
    cuts = map(slice, begins[at].tolist(), ends[last].tolist())
    digests = b"".join(map(xxhash.xxh64_digest, map(raw.__getitem__, cuts), repeat(seed)))
    return np.frombuffer(digests, dtype=">u8").astype(np.uint64), out_bounds


def _fingerprinter(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, end, data, offsets in text_chunks(batch.column(1)):
                prints = majority_bits(*_shingle_hashes(hasher, data, offsets, size, seed))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(prints.view(np.int64))],
                                                 names=["id", "fp"])
    return run


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp): each row's SimHash as a signed 64-bit number; zero for a text without words."""
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return docs.mapInArrow(_fingerprinter(size, seed), "id long, fp long")


def segment_plan(segments: int, radius: int) -> list[tuple[int, int, list[int]]]:
    """Per segment its lowest bit, its mask and the masks of its ball (the empty one first).

    The shares of the radius differ by at most one and add up to radius - segments + 1.
    """
    spare = radius - segments + 1
    if spare < 0:
        raise ValueError("more segments than radius + 1: drop some")
    cuts = [BITS * k // segments for k in range(segments + 1)]
    plan = []
    for k, (low, high) in enumerate(zip(cuts, cuts[1:])):
        share = spare // segments + (k < spare % segments)
        width = high - low
        ball = [sum(1 << b for b in bits) for d in range(share + 1) for bits in combinations(range(width), d)]
        plan.append((low, (1 << width) - 1, ball))
    return plan


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _forest(radius: int):
    """Links of low x high rows of a block pair of one segment value, as a spanning forest."""

    def run(block: pa.Table) -> pa.Table:
        fp = block.column("fp").to_numpy().view(np.uint64)
        low, high = (np.flatnonzero(block.column(c).to_numpy(zero_copy_only=False)) for c in ("is_low", "is_high"))
        group, a, b = np.arange(len(fp)), [], []
        for i in low:
            near = high[np.bitwise_count(fp[high] ^ fp[i]) <= radius]
            groups, first = np.unique(group[near], return_index=True)
            new = groups != group[i]
            if new.any():
                b.extend(fp[near[first[new]]].tolist())
                a.extend([int(fp[i])] * int(new.sum()))
                group[np.isin(group, groups)] = group[i]
        return pa.table({c: np.array(x, dtype=np.uint64).view(np.int64) for c, x in (("a", a), ("b", b))})
    return run


def fingerprint_links(stage: Stage, prints: DataFrame, radius: int = 4, segments: int | None = None,
                      crowd: int = 64, block: int = 2048) -> DataFrame:
    """Links (a, b) between the distinct ``prints`` (fp) at distance ``radius`` or less.

    Any two at that distance are linked directly or through others.  ``segments`` changes
    the work, not the result: by default their width is about the logarithm of the number
    of fingerprints, so that a segment value has few holders.  A value held or asked for
    by more than ``crowd`` fingerprints is compared in blocks of about ``block``.
    """
    if segments is None:
        segments = max(1, min(radius + 1, round(BITS / math.log2(max(4, prints.count())))))
    plan = segment_plan(segments, radius)
    value = lambda low, mask: F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(_signed(mask)))
    table = prints.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("seg"), value(low, mask).alias("value"))
                                                    for k, (low, mask, _) in enumerate(plan)])).alias("s")).select("fp", "s.*")
    # Of two values that differ, the one that has the highest differing bit asks for the other.
    ask = []
    for k, (low, mask, ball) in enumerate(plan):
        v = value(low, mask)
        for m in ball[1:]:
            top = 1 << (m.bit_length() - 1)
            ask.append(F.when(v.bitwiseAND(F.lit(_signed(top))) != 0, F.struct(F.lit(k).alias("seg"), v.bitwiseXOR(F.lit(_signed(m))).alias("value"))))
    held = table.withColumn("asks", F.lit(False))
    if ask:
        asked = prints.select("fp", F.explode(F.array_compact(F.array(*ask))).alias("s")).select("fp", "s.*", F.lit(True).alias("asks"))
        held = held.union(asked)
    rows = stage.put(held, "segments")
    sizes = rows.groupBy("seg", "value").agg(F.count_if(~F.col("asks")).alias("holders"), F.count_if("asks").alias("askers"))
    sizes = sizes.where("holders > 0 and holders + askers > 1")
    many = stage.put(sizes.where(F.col("holders") + F.col("askers") > crowd), "crowds")
    few = stage.put(sizes.where(F.col("holders") + F.col("askers") <= crowd).select("seg", "value"), "pairs")
    key = ["seg", "value"]
    small = rows.join(few.hint("merge"), key, "left_semi")
    left = small.select(*key, F.col("fp").alias("a"), "asks")
    right = small.where("not asks").select(*key, F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    once = F.col("asks") | (F.col("a") < F.col("b"))
    links = left.join(right.hint("merge"), key).where(close & once).select("a", "b")
    of = F.ceil((F.col("holders") + F.col("askers")) / block).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("of")).cast("int")
    dealt = (rows.join(many.hint("merge"), key).withColumn("of", of).withColumn("own", own)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("of") - 1))))
    # Holders meet everyone; askers meet holders only, so an asker is never on the holders' side.
    dealt = dealt.select(*key, "fp", F.col("own").alias("i"), F.col("other").alias("j"), (~F.col("asks")).alias("is_low"), F.lit(False).alias("is_high")).where("is_low").union(
        dealt.select(*key, "fp", F.col("other").alias("i"), F.col("own").alias("j"), F.lit(False), F.lit(True)))
    crowded = dealt.groupBy(*key, "i", "j").applyInArrow(_forest(radius), "a long, b long")
    return stage.put(links.union(crowded).where("a != b").distinct(), "links")


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, seed: int = 42,
                       radius: int = 4, segments: int | None = None, crowd: int = 64, block: int = 2048) -> DataFrame:
    """Every row's fingerprint and component: ``id_col``, fingerprint (16 hex digits), component_id, kept.

    Fingerprints at ``radius`` or fewer differing bits are linked; component_id is the
    smallest id reachable.  Null or empty texts and texts without a word have fingerprint
    zero and are linked like any other.  Rows may repeat ids: each row has its own
    fingerprint.  Null ids never name a component, which is null only if it holds no other
    id; ``kept`` is true for the rows whose id is the component's.  Other columns are
    ignored.  An empty table gives no rows.
    """
    stage = Stage(docs.sparkSession, "simhash")
    signed = stage.put(fingerprints(docs, id_col, text_col, size, seed), "signed")
    nodes = stage.put(signed.groupBy("fp").agg(F.min("id").alias("least")), "nodes")
    links = fingerprint_links(stage, nodes.select("fp"), radius, segments, crowd, block)
    roots = components(stage, links, "graph")
    placed = nodes.join(roots.hint("merge"), F.col("fp") == F.col("u"), "left").select("fp", "least", F.coalesce("v", "fp").alias("root"))
    placed = stage.put(placed, "placed")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    names = stage.put(placed.join(names.hint("merge"), "root").select("fp", "component_id"), "names")
    stage.drop("nodes", "segments", "crowds", "pairs", "links", "placed")
    return (signed.join(names.hint("merge"), "fp")
            .select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id",
                    F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))
