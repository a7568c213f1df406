"""Phrases counted in tiles against plain counting; bands and parts; messy inputs."""

import os
import random
import re
import sys
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(__file__))

import numpy as np  # noqa: E402
import pytest  # noqa: E402
from fixtures import empty, messy  # noqa: E402

from labeltide.llm import collocations  # noqa: E402
from labeltide.llm.collocations import _band, _block, _leading, _pairs, _side, _squeeze, mine_collocations, pack, unpack  # noqa: E402
from labeltide.llm.common import Stage  # noqa: E402


def plain(rows, max_words, min_count, top):
    """The same report by dictionaries of whole phrases."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = tuple(x for x in re.split(r"[\x20\x09]+", piece) if x)
            total[lang] += len(w)
            for s in range(1, max_words + 1):
                counts[lang].update(w[i:i + s] for i in range(len(w) - s + 1))
    out = []
    for lang, f in counts.items():
        found, best = {g: c for g, c in f.items() if len(g) > 1 and c >= min_count}, []
        for g, a in found.items():
            if any(100 * c >= 50 * a for h, c in found.items() if len(h) > len(g) and any(h[i:i + len(g)] == g for i in range(len(h)))):
                continue
            score, k = min((1_000_000 * a * a // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
            best.append((-score, -a, " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(best)[:top])]
    return sorted(out)


@pytest.mark.parametrize("max_words,min_count,top", [(3, 4, 2000), (4, 3, 25), (2, 2, 7)])
def test_messy_rows(spark, max_words, min_count, top):
    docs = messy(spark)
    rows = [(r["lang"], r["text"]) for r in docs.select("lang", "text").collect()]
    rows += [("und", rows[5][1]), ("", "a A a a a. a\ta a,a a"), ("x", ".;, ,!?\n\v\f\r")] + [("zh", "词 语 词 语 É é É é")] * 3
    docs = spark.createDataFrame([(*r, 1) for r in rows], "lang string, text string, word int").repartition(5)
    got = mine_collocations(docs, max_words=max_words, min_count=min_count, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    want = plain(rows, max_words, min_count, top)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 20


def test_no_phrase(spark):
    assert mine_collocations(empty(spark)).count() == 0
    assert mine_collocations(spark.createDataFrame([("en", "one two"), ("en", None)], "lang string, text string")).count() == 0


def test_many_words_fill_several_bands(spark, monkeypatch):
    """Ids of several bands, tiles counted in both ways; workers get the same code with its own limits."""
    rnd = random.Random(5)
    vocabulary = [f"w{k}" for k in range(700)]
    weights = [1 / (k + 3) for k in range(700)]
    rows = [(rnd.choice(["en", "de"]), " ".join(rnd.choices(vocabulary, weights, k=400))) for _ in range(60)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    for name, value in (("DENSE_CELLS", 1 << 13), ("TILE_PAIRS", 300), ("BLOCK_BYTES", 3000)):
        monkeypatch.setattr(collocations, name, value)
    got = mine_collocations(docs, min_count=5, top=500)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, 3, 5, 500)


def test_leading_rows_keep_all_that_may_be_first(spark):
    rnd = random.Random(2)
    rows = [(lang, rnd.choice([9, 9, 9, 5, 1]), rnd.randint(1, 4), k) for lang in "ab" for k in range(200)] + [("c", 1, 1, 0)]
    table = spark.createDataFrame(rows, "lang string, score long, a long, k int")
    for top in (1, 30, 170, 1000):
        got = {tuple(r) for r in _leading(Stage(spark, "test"), table, top).select("lang", "score", "a", "k").collect()}
        for lang in "abc":
            mine = sorted((r for r in rows if r[0] == lang), key=lambda r: (-r[1], -r[2]))
            last = mine[min(top, len(mine)) - 1]
            assert {r for r in got if r[0] == lang} == {r for r in mine if (r[1], r[2]) >= (last[1], last[2])}


def test_bands_and_packing():
    ids = np.array([0, 1, 63, 64, 127, 128, 1 << 20, (1 << 31) - 1, 1 << 40])
    for i, band in zip(ids, _band(ids)):
        first, wide = _side(band)
        assert first <= i < first + wide
    for a in (ids, ids[:0], np.array([-1, 5, -1])):
        assert unpack(pack(a)).tolist() == a.tolist()
    assert _squeeze(np.array([-1, -1, 3, -1, -1, -1, 4, 5])).tolist() == [-1, 3, -1, 4, 5]
    assert _pairs(np.array([1, 2, -1, 3, 4, 5]), np.array([1, 2, -1, 3, 4, 5]), 2).tolist() == [0, 3, 4]
    assert _pairs(np.array([1, 2]), np.array([7, -1]), 4).tolist() == []


def test_block_of_texts():
    texts = [b"A b.a", b"", b"  c\tC ; ", b"c"]
    data, offsets = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0] + [len(t) for t in texts])
    words, counts, codes = _block(data, offsets)
    assert [w.decode() for w in words.to_pylist()] == ["a", "b", "c"] and counts.tolist() == [2, 1, 3]
    assert codes.tolist() == [0, 1, -1, 0, -1, 2, 2, -1, 2]
