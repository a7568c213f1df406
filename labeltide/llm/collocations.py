"""Operator 12: phrase collocations, counted in direct-address tiles of pair ids.

1. Texts are cut into blocks of one language.  A block is one row: its distinct words
   with their counts, and its text as numbers of these words, breaks between.
2. Words with at least ``min_count`` occurrences get an id by falling frequency, per
   language (a phrase never occurs more often than its words).  A block's dictionary
   comes back from the join with these ids, and its text is rewritten in ids.
3. A phrase of one word more is a pair: the id of its beginning and that of its next
   word.  Pairs fall into tiles, whose sides double with the rank, so that tiles hold
   similar numbers of occurrences.  Each block counts its own pairs and sends, for each
   tile, sorted cell numbers and counts.  A small (dense) tile is added up by direct
   address with ``bincount``, a large (sparse) one as a sorted coordinate list.  A tile
   with many occurrences is dealt out by cell number.
4. Frequent pairs are ranked anew by frequency, the blocks that hold them learn their
   ids, and the next length is counted the same way.
5. Scores, containment and the report are joins and aggregates over frequent phrases.

Blocks and tiles have bounded sizes, nothing but per-band totals reaches the driver, and
every occurrence counts: what is left out cannot belong to a phrase of ``min_count``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labeltide.llm.common import Stage
from labeltide.llm.wordhash import text_chunks
from labeltide.operators.ordering import dense_row_number

BLOCK_BYTES = 1 << 22
#: Ids below 2^HEAD_BITS share the first band; every further band is as wide as all before it.
HEAD_BITS = 6
#: Tiles of up to this many cells are counted by direct address.
DENSE_CELLS = 1 << 22
#: Occurrences of pairs that one task may add up at most, repeats within a block counted once.
TILE_PAIRS = 1 << 21

_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = 1  # between words
_KIND[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = 2  # between pieces
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pack(a: np.ndarray) -> bytes:
    """Integers of 0 and above, or -1, compressed."""
    kind = "<i4" if not len(a) or a.max() < 1 << 31 else "<i8"
    data = a.astype(kind).tobytes()
    return bytes([int(kind[2])]) + len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def unpack(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[1:9], "little")
    raw = pa.decompress(data[9:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return np.frombuffer(raw, dtype=f"<i{data[0]}").astype(np.int64)


def _block(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, their counts, the text as word numbers with -1 between pieces) of a run of documents."""
    kind = _KIND[data]
    solid = kind == 0
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    head = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[head] = solid[head]
    starts = np.flatnonzero(first)
    lengths = np.bincount(np.cumsum(first, dtype=np.int32)[solid] - 1, minlength=len(starts))
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(_LOWER[data[solid]])])
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy().astype(np.int64)
    counts = np.bincount(codes, minlength=len(coded.dictionary))
    # A word starts a piece if a piece separator or the start of its document lies after the word before.
    cut = kind == 2
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    place = np.cumsum(cut, dtype=np.int32)[starts]
    opens = np.concatenate(([False], place[1:] != place[:-1])) if len(place) else np.zeros(0, dtype=bool)
    return coded.dictionary, counts, np.insert(codes, np.flatnonzero(opens), -1)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to one row per block; a block's number is unique in a stored table."""
    number = TaskContext.get().partitionId() << 32
    for batch in batches:
        langs = batch.column(0).dictionary_encode()
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            texts = batch.column(1).filter(pa.array(langs.indices.to_numpy() == k))
            for _, _, data, offsets in text_chunks(texts, BLOCK_BYTES):
                words, counts, codes = _block(data, offsets)
                number += 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([lang]), pa.array([int(counts.sum())]),
                    pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.binary()).view(pa.string())),
                    pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(counts)), pa.array([pack(codes)], pa.binary())],
                    names=["block", "lang", "n", "words", "counts", "codes"])


def _squeeze(ids: np.ndarray) -> np.ndarray:
    """Several -1 in a row become one."""
    keep = np.ones(len(ids), dtype=bool)
    keep[1:] = (ids[1:] >= 0) | (ids[:-1] >= 0)
    return ids[keep]


def _rewrite(left: pa.Table, right: pa.Table) -> pa.Table:
    """A block's text in word ids; words that got none become breaks."""
    block = left.select(["block", "lang"])
    codes = unpack(left.column("codes")[0].as_py()) if left.num_rows else np.zeros(0, dtype=np.int64)
    place, ids = right.column("place").to_numpy().astype(np.int64), right.column("id").to_numpy().astype(np.int64)
    of = np.full(max(int(codes.max(initial=-1)) + 2, 1), -1, dtype=np.int64)  # the last entry is that of -1
    inside = place < len(of) - 1
    of[place[inside]] = ids[inside]
    text = pa.array([pack(_squeeze(of[codes]))] * left.num_rows, pa.binary())
    return block.append_column("words", text).append_column("grams", text)


def _pairs(words: np.ndarray, grams: np.ndarray, size: int) -> np.ndarray:
    """Places where a phrase of ``size`` words may start: its first and its last size - 1 words are phrases with an id."""
    last = max(len(words) - size + 1, 0)
    good = (grams[:last] >= 0) & (words[size - 1:] >= 0) if last else np.zeros(0, dtype=bool)
    if size > 2:
        good &= grams[1:last + 1] >= 0
    return np.flatnonzero(good)


def _band(ids: np.ndarray) -> np.ndarray:
    return np.maximum(np.frexp(ids.astype(np.float64))[1] - HEAD_BITS, 0)


def _side(band):
    """(first id, number of ids) of a band."""
    width = 1 << (HEAD_BITS + max(int(band) - 1, 0))
    return (0 if not band else width), width


def _count_blocks(size: int, parts: dict[str, np.ndarray]):
    """Each block's distinct pairs by (tile, part): sorted cell numbers and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, lang, words, grams in zip(*(c.to_pylist() for c in batch.columns)):
                w, g = unpack(words), unpack(grams)
                at = _pairs(w, g, size)
                a, b = g[at], w[at + size - 1]
                if not len(a):
                    continue
                ba, bb = _band(a), _band(b)
                tile = ba * 64 + bb
                width_b = np.int64(1) << (HEAD_BITS + np.maximum(bb - 1, 0)).astype(np.int64)
                low = lambda band: np.where(band > 0, np.int64(1) << (HEAD_BITS + np.maximum(band - 1, 0)).astype(np.int64), 0)
                cell = (a - low(ba)) * width_b + (b - low(bb))
                of = parts[lang][tile]
                group, cell = tile.astype(np.int64) << 32 | cell % of, cell // of
                order = np.lexsort((cell, group))
                group, cell = group[order], cell[order]
                new = np.concatenate(([True], (group[1:] != group[:-1]) | (cell[1:] != cell[:-1])))
                first = np.flatnonzero(new)
                counts, group, cell = np.diff(np.append(first, len(cell))), group[first], cell[first]
                cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
                ends = np.append(cuts[1:], len(group))
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(cuts)), pa.array((group[cuts] >> 32).astype(np.int32)), pa.array(group[cuts] & 0xFFFFFFFF), pa.array([block] * len(cuts), pa.int64()),
                    pa.array([pack(np.diff(cell[i:j], prepend=0)) for i, j in zip(cuts, ends)], pa.binary()),
                    pa.array([pack(counts[i:j]) for i, j in zip(cuts, ends)], pa.binary())], names=["lang", "tile", "part", "block", "cells", "counts"])
    return run


def _add_tile(min_count: int, parts: dict[str, np.ndarray], again: bool):
    """A tile part's frequent pairs (block null) and, for the next length, the blocks that hold them (count null)."""

    def run(group: pa.Table) -> pa.Table:
        lang, tile, part = (group.column(c)[0].as_py() for c in ("lang", "tile", "part"))
        of = int(parts[lang][tile])
        (low_a, wide_a), (low_b, wide_b) = _side(tile // 64), _side(tile % 64)
        blocks = group.column("block").to_numpy()
        cells = [np.cumsum(unpack(x)) for x in group.column("cells").to_pylist()]
        counts = [unpack(x) for x in group.column("counts").to_pylist()]
        sizes = [len(x) for x in cells]
        cell, count = np.concatenate(cells), np.concatenate(counts)
        if wide_a * wide_b // of <= DENSE_CELLS:
            total = np.bincount(cell, weights=count)  # whole numbers below 2^53
            frequent = np.flatnonzero(total >= min_count)
            total = total[frequent].astype(np.int64)
        else:
            order = np.argsort(cell, kind="stable")
            ranked = cell[order]
            first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
            total = np.add.reduceat(count[order], first)
            frequent, total = ranked[first][total >= min_count], total[total >= min_count]
        n = len(frequent)
        used = np.isin(cell, frequent) if again else np.zeros(len(cell), dtype=bool)
        held, holder = cell[used], np.repeat(blocks, sizes)[used]
        place = np.concatenate((frequent, held)) * of + part
        null = np.arange(len(place)) < n
        return pa.table({"block": pa.array(np.concatenate((np.zeros(n, dtype=np.int64), holder)), mask=null), "lang": pa.array([lang] * len(place), pa.string()),
                         "a": pa.array(place // wide_b + low_a), "b": pa.array(place % wide_b + low_b),
                         "f": pa.array(np.concatenate((total, np.zeros(len(held), dtype=np.int64))), mask=~null)})
    return run


def _regram(size: int):
    """A block's text with the ids of its frequent phrases of ``size`` words."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(["block", "lang", "words", "grams"])
        w, g = unpack(left.column("words")[0].as_py()), unpack(left.column("grams")[0].as_py())
        at = _pairs(w, g, size)
        out = np.full(len(w), -1, dtype=np.int64)
        a, b, ids = (right.column(c).to_numpy() for c in ("a", "b", "id"))
        if len(at) and len(a):
            wide = max(int(w.max()), int(b.max())) + 1
            key = a * wide + b
            order = np.argsort(key)
            key, ids = key[order], ids[order]
            mine = g[at] * wide + w[at + size - 1]
            spot = np.minimum(np.searchsorted(key, mine), len(key) - 1)
            out[at] = np.where(key[spot] == mine, ids[spot], -1)
        return left.select(["block", "lang", "words"]).append_column("grams", pa.array([pack(out)], pa.binary()))
    return run


def _ranked(df: DataFrame, *ties: str) -> DataFrame:
    """``df`` with ``id``: its rank from 0 by falling ``f`` within its language."""
    numbered = dense_row_number(df.withColumn("_order", F.struct("lang", -F.col("f"), *ties)), "_order", "_row").drop("_order")
    firsts = numbered.groupBy(F.col("lang").alias("_lang")).agg(F.min("_row").alias("_first"))
    return numbered.join(firsts, F.col("lang") == F.col("_lang")).withColumn("id", F.col("_row") - F.col("_first")).drop("_lang", "_first", "_row")


def _band_totals(grams: DataFrame) -> dict[str, np.ndarray]:
    """Per language the occurrences of each band's ids."""
    band = F.greatest(F.length(F.bin("id")) - HEAD_BITS, F.lit(0))
    out: dict[str, np.ndarray] = {}
    for r in grams.groupBy("lang", band.alias("band")).agg(F.sum("f").alias("f")).collect():
        out.setdefault(r["lang"], np.zeros(64, dtype=np.int64))[r["band"]] = r["f"]
    return out


def _parts(left: dict[str, np.ndarray], right: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Per language and tile the number of parts: no tile occurs more often than either of its bands."""
    none = np.zeros(64, dtype=np.int64)
    return {lang: np.maximum(-(-np.minimum.outer(left.get(lang, none), right[lang]) // TILE_PAIRS), 1).ravel() for lang in right}


def phrase_counts(stage: Stage, docs: DataFrame, lang_col: str, text_col: str, max_words: int, min_count: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(phrases, words, totals): (lang, ids, f) of all frequent phrases; (lang, id, word, f) of the frequent words; (lang, n) of all words."""
    text = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    blocks = stage.put(text.mapInArrow(_blocks, "block long, lang string, n long, words array<string>, counts array<long>, codes binary"), "blocks")
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    each = blocks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).select("lang", "w.*")
    frequent = each.groupBy("lang", F.col("words").alias("word")).agg(F.sum("counts").alias("f")).where(F.col("f") >= min_count)
    words = stage.put(_ranked(frequent, "word"), "words")
    places = blocks.select("block", "lang", F.posexplode("words").alias("place", "word"))
    dictionary = places.join(words.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("holder"), "place", "id")
    shape = "block long, lang string, words binary, grams binary"
    texts = (blocks.select("block", "lang", "codes").groupBy("block").cogroup(dictionary.groupBy("holder")).applyInArrow(_rewrite, shape))
    texts = stage.put(texts, "texts-1")
    phrases = words.select("lang", F.array("id").alias("ids"), "f")
    shorter, right = words.select("lang", "id", "f", F.array("id").alias("ids")), _band_totals(words)
    for size in range(2, max_words + 1):
        parts = _parts(_band_totals(shorter), right)
        counted = texts.mapInArrow(_count_blocks(size, parts), "lang string, tile int, part long, block long, cells binary, counts binary")
        found = counted.groupBy("lang", "tile", "part").applyInArrow(_add_tile(min_count, parts, size < max_words), "block long, lang string, a long, b long, f long")
        found = stage.put(found, f"tiles-{size}")
        ranked = stage.put(_ranked(found.where("block is null").drop("block"), "a", "b"), f"pairs-{size}")
        begin = shorter.select("lang", F.col("id").alias("a"), F.col("ids").alias("begin"))
        shorter = ranked.join(begin, ["lang", "a"]).select("lang", "id", "f", F.concat("begin", F.array("b")).alias("ids"))
        shorter = stage.put(shorter, f"phrases-{size}")
        phrases = phrases.union(shorter.select("lang", "ids", "f"))
        if size < max_words:
            known = found.where("block is not null").select(F.col("block").alias("holder"), "lang", "a", "b").join(ranked.select("lang", "a", "b", "id"), ["lang", "a", "b"])
            texts = texts.groupBy("block").cogroup(known.select("holder", "a", "b", "id").groupBy("holder")).applyInArrow(_regram(size), shape)
            texts = stage.put(texts, f"texts-{size}")
        stage.drop(f"texts-{size - 1}", f"tiles-{size}", f"pairs-{size}")
    totals = stage.put(totals, "totals")
    stage.drop("blocks", f"texts-{max_words}")
    return phrases, words, totals


def _exact_score(f: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * f * f / (left * right)) in decimals."""
    f, left, right = (x.cast("decimal(18,0)") for x in (f, left, right))
    return F.call_function("div", F.lit(1_000_000) * (f * f), left * right).cast("long")


def scored_phrases(phrases: DataFrame, contained_percent: int = 50) -> DataFrame:
    """(lang, ids, a, l, r, score) of the phrases of two or more words that no longer one replaces."""
    candidates = phrases.where(F.size("ids") > 1)
    cuts = candidates.select("lang", "ids", "f", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = (cuts.withColumn("left", F.expr("slice(ids, 1, k)")).withColumn("right", F.expr("slice(ids, k + 1, size(ids))"))
            .join(phrases.select("lang", F.col("ids").alias("left"), F.col("f").alias("l")), ["lang", "left"])
            .join(phrases.select("lang", F.col("ids").alias("right"), F.col("f").alias("r")), ["lang", "right"]))
    best = cuts.groupBy("lang", "ids", F.col("f").alias("a")).agg(
        F.min(F.struct(_exact_score(F.col("f"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), s -> transform(sequence(1, size(ids) - s + 1), i -> slice(ids, i, s))))")
    longer = (candidates.where(F.size("ids") > 2).select("lang", F.explode(inner).alias("ids"), "f")
              .groupBy("lang", "ids").agg(F.max("f").alias("longer")))
    kept = best.join(longer, ["lang", "ids"], "left").where(F.coalesce(100 * F.col("longer") < contained_percent * F.col("a"), F.lit(True)))
    return kept.select("lang", "ids", "a", "cut.l", "cut.r", "cut.score")


def _leading(stage: Stage, scored: DataFrame, top: int) -> DataFrame:
    """The rows that may be among a language's first ``top`` by score and a: of these, only ties at the last place go beyond.

    Histograms of the score (at most 1,000,001 values), then of a at the last score, find that place; no language is sorted as a whole.
    """
    ahead = lambda c: F.sum("c").over(Window.partitionBy("lang").orderBy(F.col(c).desc()).rowsBetween(Window.unboundedPreceding, -1))
    bins = scored.groupBy("lang", "score").agg(F.count(F.lit(1)).alias("c")).withColumn("ahead", F.coalesce(ahead("score"), F.lit(0)))
    cut = bins.where(F.col("ahead") < top).groupBy(F.col("lang").alias("_lang")).agg(F.min_by(F.struct("score", "ahead"), "score").alias("cut"))
    cut = stage.put(cut.select("_lang", F.col("cut.score").alias("_score"), F.col("cut.ahead").alias("_ahead")), "score-cut")
    scored = scored.join(cut, F.col("lang") == F.col("_lang")).where("score >= _score")
    tied = scored.where("score = _score").groupBy("lang", "_ahead", "a").agg(F.count(F.lit(1)).alias("c"))
    tied = tied.withColumn("ahead", F.col("_ahead") + F.coalesce(ahead("a"), F.lit(0))).where(F.col("ahead") < top)
    last = stage.put(tied.groupBy("lang").agg(F.min("a").alias("_a")), "count-cut")
    return scored.join(last, "lang").where("score > _score or a >= _a").drop("_lang", "_score", "_ahead", "_a")


def mine_collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", max_words: int = 3, min_count: int = 10,
                      top: int = 2000, contained_percent: int = 50) -> DataFrame:
    """Each language's ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces and words; a phrase is 2 to ``max_words``
    words within a piece that occur ``min_count`` times or more, overlaps included.  Its
    score is the least, over its cuts into two parts, of floor(1000000 a^2 / (l r)).  A
    phrase within a longer one that has ``contained_percent`` of its count or more is left out.
    Order: score, count, then the phrase's bytes.

    Null languages are ``und``, together with a language of that name; null and empty texts
    have no words.  Rows may repeat and count each time; other columns are ignored.  An
    empty table, or one without frequent phrases, gives no rows.
    """
    stage = Stage(docs.sparkSession, "collocations")
    phrases, words, totals = phrase_counts(stage, docs, lang_col, text_col, max_words, min_count)
    scored = stage.put(scored_phrases(phrases, contained_percent), "scored")
    first = stage.put(_leading(stage, scored, top), "leading")
    spelled = (first.select("lang", "ids", F.posexplode("ids").alias("k", "id")).join(words.select("lang", "id", "word"), ["lang", "id"])
               .groupBy("lang", "ids").agg(F.sort_array(F.collect_list(F.struct("k", "word"))).alias("w"))
               .select("lang", "ids", F.array_join(F.transform("w", lambda x: x["word"]), " ").alias("phrase")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    out = first.join(spelled, ["lang", "ids"]).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    out = stage.put(out.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score"), "report")
    stage.drop("words", "totals", "scored", "leading", "score-cut", "count-cut", *[f"phrases-{k}" for k in range(2, max_words + 1)])
    return out
