"""Operator 3: benchmark decontamination with a BM25 index of the test items and block-max WAND.

Every item is cut into parts of at most ``part_words`` words; the parts are the
documents of the index, and their BM25 impacts are divided by the score that
the part gives itself, so one threshold fits all.  Every document is cut into
overlapping passages of twice that length, so a part always lies whole in one
passage, and every passage is a query that retrieves all parts above the
threshold.

A part's postings are split as in WAND: what its weaker terms can give together
stays below half the threshold, so a passage has to hit some of its stronger
(essential) terms.  Postings of essential terms are stored by block of parts
with the block's largest impact; a block is opened only for passages whose
block-max sum plus what the weaker terms may add reaches the threshold, then its
parts are bounded in the same way, and only the rest is scored in full.  All
passages of a chunk of text go through each step together.

A retrieved item counts as found if enough of its question and of its answer lies
in the passages that retrieved it and an item's length around them.  What lies
there of a side is the larger of two shares: of its word shingles, in any order,
and of its words in one alignment, which an edit costs one word and not three
shingles.  Without an answer column the two sides are only a guess, so an item
also counts if ``WHOLE`` of all its words lie there in one alignment.

The index is built in slices of bounded size, and documents pass through one
slice after the other.  A slice's results are stored and its broadcast is destroyed
before the next is built, so neither the driver nor the workers hold more than one;
only the last slice is left to the caller's plan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labeltide.llm.common import WORD_PATTERN, Stage
from labeltide.llm.wordhash import WordHasher, shingles, text_chunks

K1, B = 1.2, 0.75
PART_WORDS, BLOCK = 64, 8
SLICE_ITEMS, SLICE_BYTES = 5000, 8 << 20
WHOLE = 0.75


def _hashed(hasher: WordHasher, texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offsets in text_chunks(pa.array(texts, pa.string())):
        words, _, _, bounds = hasher.words(data, offsets)
        out.extend(words[a:b] for a, b in zip(bounds[:-1], bounds[1:]))
    return out


def split_answer(text: str, least_words: int = 5) -> tuple[str, str]:
    """Question and answer of an item that has no answer column: the fewest last sentences of ``least_words`` words, if a sentence is left before them."""
    for m in reversed([*re.finditer(r"[.?!]\s+", text.rstrip())]):
        if len(text[m.end():].split()) >= least_words:
            return text[:m.end()], text[m.end():]
    return text, ""


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    return np.unique(shingles(words, np.array([0, len(words)]), size)[0])


def _aligned(side: np.ndarray, text: np.ndarray) -> float:
    """1 less the fewest word edits that turn ``side`` into some stretch of ``text``, as a share of its words."""
    place = np.arange(len(text) + 1)
    cost = np.zeros(len(text) + 1, dtype=np.int64)
    for k, word in enumerate(side):
        here = np.append(k + 1, np.minimum(cost[:-1] + (text != word), cost[1:] + 1))
        cost = np.minimum.accumulate(here - place) + place
    return 1 - int(cost.min()) / len(side)


class ItemIndex:
    """BM25 index of one slice of the items; see the module text.  ``split``: the items' sides come from :func:`split_answer`."""

    def __init__(self, items: list[tuple], frequency: dict[int, int], n_parts: int, average: float,
                 threshold: float, part_words: int, block: int, split: bool = False):
        hasher = WordHasher()
        self.threshold, self.part_words, self.block, self.split = threshold, part_words, block, split
        self.items, self.owner, parts, self.checks = [i for i, _, _ in items], [], [], []
        for k, (question, answer) in enumerate(zip(_hashed(hasher, [q for _, q, _ in items]), _hashed(hasher, [a for _, _, a in items]))):
            words = np.concatenate((question, answer))
            self.checks.append([(w, _grams(w, size), size) for w in (question, answer) if len(w) for size in [min(3, len(w))]])
            for start in range(0, len(words), part_words):
                parts.append(words[start:start + part_words])
                self.owner.append(k)
        self.owner = np.array(self.owner, dtype=np.int64)
        self.terms = np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.uint64)
        df = np.array([frequency.get(int(t.view(np.int64)), 1) for t in self.terms], dtype=np.float64)
        idf = np.log(1 + (n_parts - df + 0.5) / (df + 0.5))
        term, part, impact, essential = [], [], [], []
        self.rest = np.zeros(len(parts))
        for k, words in enumerate(parts):
            found, tf = np.unique(np.searchsorted(self.terms, words), return_counts=True)
            score = idf[found] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / average))
            score = score / score.sum()
            order = np.argsort(score)
            weak = np.cumsum(score[order]) < threshold / 2
            self.rest[k] = score[order][weak].sum()
            strong = np.ones(len(found), dtype=bool)
            strong[order[weak]] = False
            term.append(found), part.append(np.full(len(found), k)), impact.append(score), essential.append(strong)
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, dtype=t)
        term, part, impact, strong = join(term, np.int64), join(part, np.int64), join(impact, np.float64), join(essential, bool)
        self.n_parts, self.n_blocks = len(parts), -(-len(parts) // block)
        # All postings, by (term, part); the essential ones by (block, term) with the block's largest impact.
        order = np.lexsort((part, term))
        self.posting_key, self.posting_impact = term[order] * max(1, self.n_parts) + part[order], impact[order]
        term, part, impact = term[strong], part[strong], impact[strong]
        key = term * max(1, self.n_blocks) + part // block
        order = np.argsort(key, kind="stable")
        key, self.in_part, self.in_impact = key[order], part[order], impact[order]
        self.cell_key, first = np.unique(key, return_index=True)
        self.cell_cut = np.append(first, len(key))
        self.cell_max = np.maximum.reduceat(self.in_impact, first) if len(first) else np.zeros(0)
        self.cell_block = self.cell_key % max(1, self.n_blocks)
        self.term_cells = np.searchsorted(self.cell_key, np.arange(len(self.terms) + 1) * max(1, self.n_blocks))
        pad = np.append(self.rest, np.zeros(self.n_blocks * block - self.n_parts))
        self.block_rest = pad.reshape(-1, block).max(axis=1) if self.n_blocks else np.zeros(0)

    def search(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, float, int, int]]:
        """(document, part, score, first word, end word) of every passage and part at or above the threshold."""
        if not len(words) or not len(self.terms):
            return
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        term = np.where(self.terms[at] == words, at, -1)
        step = self.part_words
        counts = np.diff(bounds)
        n_windows = np.maximum(1, -(-counts // step) - 1) * (counts > 0)
        doc = np.repeat(np.arange(len(counts)), n_windows)
        order = np.arange(len(doc)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        start = bounds[doc] + order * step
        place = start[:, None] + np.arange(2 * step)
        inside = place < bounds[doc + 1][:, None]
        grid = np.where(inside, term[np.minimum(place, len(term) - 1)], -1)
        grid.sort(axis=1)
        fresh = grid >= 0
        fresh[:, 1:] &= grid[:, 1:] != grid[:, :-1]
        window, _ = np.nonzero(fresh)
        found = grid[fresh]
        self_start = np.searchsorted(window, np.arange(len(doc) + 1))

        # Blocks whose essential terms and weaker rest can reach the threshold.
        owner, cell = _expand(self.term_cells, found)
        pair = window[owner] * self.n_blocks + self.cell_block[cell]
        opened = _reach(pair, self.cell_max[cell], lambda key: self.block_rest[key % self.n_blocks], self.threshold)
        keep = np.isin(pair, opened)
        # Their parts, bounded in the same way.
        which, posting = _expand(self.cell_cut, cell[keep])
        pair = window[owner[keep]][which] * self.n_parts + self.in_part[posting]
        likely = _reach(pair, self.in_impact[posting], lambda key: self.rest[key % self.n_parts], self.threshold)
        for key in likely:
            w, part = divmod(int(key), self.n_parts)
            own = found[self_start[w]:self_start[w + 1]] * self.n_parts + part
            hit = np.minimum(np.searchsorted(self.posting_key, own), len(self.posting_key) - 1)
            score = self.posting_impact[hit][self.posting_key[hit] == own].sum()
            if score >= self.threshold - 1e-9:
                yield int(doc[w]), part, float(score), int(start[w]), int(min(start[w] + 2 * step, bounds[doc[w] + 1]))

    def matches(self, words: np.ndarray, bounds: np.ndarray, least: float) -> dict[int, list[tuple]]:
        """Per document: (item, passages, best score, question overlap, answer overlap) of the verified items."""
        hits: dict[tuple[int, int], list] = {}
        for doc, part, score, start, end in self.search(words, bounds):
            hits.setdefault((doc, int(self.owner[part])), []).append((score, start, end))
        out: dict[int, list[tuple]] = {}
        for (doc, item), found in sorted(hits.items()):
            spans, sides = sorted({(a, b) for _, a, b in found}), self.checks[item]
            around, runs = sum(len(side) for side, _, _ in sides), []
            for a, b in spans:
                a, b = max(a - around, int(bounds[doc])), min(b + around, int(bounds[doc + 1]))
                if runs and a <= runs[-1][1]:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            texts = [words[a:b] for a, b in runs]
            overlap = [1.0, 1.0]
            for k, (side, grams, size) in enumerate(sides):
                seen = np.unique(np.concatenate([_grams(text, size) for text in texts]))
                overlap[k] = float(np.isin(grams, seen).mean())
                if overlap[k] < 1:
                    overlap[k] = max(overlap[k], *[_aligned(side, text) for text in texts])
            if min(overlap) >= least or self.split and max(_aligned(np.concatenate([w for w, _, _ in sides]), text) for text in texts) >= WHOLE:
                out.setdefault(doc, []).append((self.items[item], len(spans), max(s for s, _, _ in found), *overlap))
        return out


def _expand(cuts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``rows``, the numbers cuts[r]..cuts[r + 1]: (position in rows, number)."""
    n = cuts[rows + 1] - cuts[rows]
    owner = np.repeat(np.arange(len(rows)), n)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + cuts[rows][owner]


def _reach(pair: np.ndarray, value: np.ndarray, rest, threshold: float) -> np.ndarray:
    """The distinct ``pair`` keys whose values sum to the threshold with what ``rest`` may add."""
    key, at = np.unique(pair, return_inverse=True)
    total = np.bincount(at, weights=value, minlength=len(key))
    return key[total + rest(key) >= threshold - 1e-9]


def _finder(index, id_type: pa.DataType, item_type: pa.DataType, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, items = WordHasher(), index.value
        for batch in batches:
            rows: list[tuple] = []
            for first, _, data, offsets in text_chunks(batch.column(1)):
                words, _, _, bounds = hasher.words(data, offsets)
                for doc, found in items.matches(words, bounds, least).items():
                    rows += [(batch.column(0)[first + doc].as_py(), *f) for f in found]
            columns = list(zip(*rows)) or [[] for _ in range(6)]
            types = (id_type, item_type, pa.int64(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             names=["id", "item", "n_passages", "score", "question_overlap", "answer_overlap"])
    return run


def _dropper(index, text_at: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, items = WordHasher(), index.value
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for first, _, data, offsets in text_chunks(batch.column(text_at)):
                words, _, _, bounds = hasher.words(data, offsets)
                clean[[first + doc for doc in items.matches(words, bounds, least)]] = False
            yield batch.filter(pa.array(clean))
    return run


def _part_terms(part_words: int):
    """(distinct term, 1) of every part of the items, for the document frequencies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            parts = [w[k:k + part_words] for w in _hashed(hasher, batch.column(0).to_pylist()) for k in range(0, len(w), part_words)]
            terms = np.concatenate([np.unique(p) for p in parts]) if parts else np.zeros(0, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64))], names=["term"])
    return run


def item_indexes(benchmark: DataFrame, item_col: str = "item_id", question_col: str = "text", answer_col: str | None = None,
                 threshold: float = 0.6, part_words: int = PART_WORDS, block: int = BLOCK) -> Iterator[tuple[ItemIndex, bool]]:
    """The index in slices of about ``SLICE_ITEMS`` items or ``SLICE_BYTES`` bytes of text, whichever is less, and whether it is the last.

    Items without a word are left out.  Document frequencies are those of all items.
    """
    question = F.coalesce(F.col(question_col), F.lit(""))
    answer = F.coalesce(F.col(answer_col), F.lit("")) if answer_col else F.lit("")
    items = benchmark.select(F.col(item_col).alias("item"), question.alias("question"), answer.alias("answer"))
    whole = F.concat_ws(" ", "question", "answer")
    items = items.where(whole.rlike(WORD_PATTERN))
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(whole)).alias("bytes"),
                     F.sum(F.ceil(F.regexp_count(whole, F.lit(WORD_PATTERN)) / part_words)).alias("parts"),
                     F.sum(F.regexp_count(whole, F.lit(WORD_PATTERN))).alias("words")).first()
    if not size["n"]:
        return
    slices = max(1, -(-size["n"] // SLICE_ITEMS), -(-size["bytes"] // SLICE_BYTES))
    sliced = items.withColumn("slice", F.pmod(F.xxhash64("item", "question"), F.lit(slices)))
    terms = items.select(whole.alias("text")).mapInArrow(_part_terms(part_words), "term long")
    frequency = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    for k in range(slices):
        own = sliced.where(F.col("slice") == k)
        rows = own.orderBy("item").select("item", "question", "answer").collect()
        if not rows:
            continue
        here = own.select(whole.alias("text")).mapInArrow(_part_terms(part_words), "term long").distinct()
        df = {r["term"]: r["df"] for r in frequency.join(here, "term", "left_semi").collect()}
        texts = [(r["item"], r["question"], r["answer"]) if answer_col else (r["item"], *split_answer(r["question"])) for r in rows]
        made = (texts, df, int(size["parts"]), size["words"] / size["parts"], threshold, part_words, block, answer_col is None)
        yield ItemIndex(*made), k == slices - 1


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                   question_col: str = "text", answer_col: str | None = None, threshold: float = 0.6, least: float = 0.6) -> DataFrame:
    """One row per document and benchmark item found in it.

    Columns: ``id_col``, ``item_col``, n_passages, score (best share of the item's own BM25
    score), question_overlap, answer_overlap.  Null or empty texts hold nothing; null or
    empty items are found nowhere; rows and items that repeat give repeated results.  An
    empty table on either side gives no rows.  Other columns are ignored.
    """
    spark = docs.sparkSession
    id_field, item_field = docs.schema[id_col], benchmark.schema[item_col]
    ddl = (f"id {id_field.dataType.simpleString()}, item {item_field.dataType.simpleString()}, "
           "n_passages long, score double, question_overlap double, answer_overlap double")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = spark.createDataFrame([], ddl)
    from pyspark.sql.pandas.types import to_arrow_type

    stage = Stage(spark, "benchmark")
    for k, (index, last) in enumerate(item_indexes(benchmark, item_col, question_col, answer_col, threshold)):
        held = spark.sparkContext.broadcast(index)
        del index
        found = rows.mapInArrow(_finder(held, to_arrow_type(id_field.dataType), to_arrow_type(item_field.dataType), least), ddl)
        if not last:
            found = stage.put(found, f"slice-{k}")
            held.destroy()
        out = out.union(found)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                  question_col: str = "text", answer_col: str | None = None, threshold: float = 0.6, least: float = 0.6) -> DataFrame:
    """``docs`` without the rows in which an item is found; no shuffle, all columns as they are."""
    spark = docs.sparkSession
    stage = Stage(spark, "benchmark")
    for k, (index, last) in enumerate(item_indexes(benchmark, item_col, question_col, answer_col, threshold)):
        held = spark.sparkContext.broadcast(index)
        del index
        docs = docs.mapInArrow(_dropper(held, docs.columns.index(text_col), least), docs.schema)
        if not last:
            docs = stage.put(docs, f"slice-{k}")
            held.destroy()
            if k:
                stage.drop(f"slice-{k - 1}")
    return docs
