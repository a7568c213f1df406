"""Near-duplicates against brute force, hot groups, messy inputs."""

import os
import random
import sys

sys.path.insert(0, os.path.dirname(__file__))

import numpy as np  # noqa: E402
import pytest  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402
from fixtures import empty, messy, sentence  # noqa: E402

from labeltide.llm.common import Stage  # noqa: E402
from labeltide.llm.components import components  # noqa: E402
from labeltide.llm.near_dedup import _field, _field_bits, near_duplicates, superminhash  # noqa: E402
from labeltide.llm.wordhash import mix  # noqa: E402


def word_set(text, size):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size, percent):
    """Per row (id, number of shingles, smallest id reachable, null only if there is none); rows are linked by their texts only."""
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [word_set(t, size) for _, t in rows]
    for k, a in enumerate(sets):
        for j, b in enumerate(sets[:k]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(k), root(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(sets[k]), least.get(root(k))) for k, (i, _) in enumerate(rows)], [root(k) for k in range(len(rows))]


def text(rows):
    return sorted(str(tuple(r)) for r in rows)


@pytest.mark.parametrize("size", [4, 5])
def test_messy_rows(spark, size):
    """Null ids, repeated ids with equal and with unrelated texts, empty texts: every row counts for itself."""
    docs = messy(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want, root = brute(rows, size, 80)
    got = near_duplicates(docs, size=size)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    got = got.collect()
    assert text(r[:3] for r in got) == text(want)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    numbered = spark.createDataFrame([(i, t, k, 0) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row long, node int")
    staying = near_duplicates(numbered, size=size, row_col="row").where("stays").collect()
    assert sorted(root[r["row"]] for r in staying) == sorted(set(root))
    assert all(r["doc_id"] == r["component_id"] for r in staying)


def test_unrelated_texts_under_one_id_and_copies_without_id(spark):
    rnd = random.Random(4)
    a, b, c = (sentence(rnd, 60) for _ in range(3))
    near = " ".join(["changed"] + c.split(" ")[1:])
    docs = spark.createDataFrame([(7, a), (7, b), (5, c), (None, near), (None, near)], "doc_id long, text string")
    got = sorted(str((r["doc_id"], r["component_id"])) for r in near_duplicates(docs).collect())
    assert got == sorted(["(7, 7)", "(7, 7)", "(5, 5)", "(None, 5)", "(None, 5)"])


@pytest.mark.parametrize("block", [7, 16])
def test_family_of_weak_copies_is_compared_in_full(spark, block):
    """Copies near the threshold to each other, of which only some are linked; small blocks so that several meet."""
    rnd = random.Random(1)
    base = sentence(rnd, 120).split(" ")
    rows = []
    for i in range(90):
        w = list(base)
        for k in rnd.sample(range(len(w)), rnd.randint(1, 5)):
            w[k] = f"w{i}x{k}"
        rows.append((i * 3 + 1, " ".join(w)))
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = near_duplicates(docs, size=4, block=block).collect()
    assert text(r[:3] for r in got) == text(brute(rows, 4, 80)[0])


def test_field_holds_all_keys(spark):
    keys = spark.range(3000).select(F.xxhash64("id").alias("k1")).repartition(5)
    field = _field(keys)
    k1 = np.array([r["k1"] for r in keys.collect()])
    assert np.all([field[p >> 3] >> (p & 7) & 1 for p in _field_bits(k1)])
    assert np.unpackbits(field).sum() <= 6000


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).count() == 0


def test_signature_estimates_similarity():
    rnd = np.random.default_rng(0)
    pool = mix(rnd.integers(0, 1 << 62, 900, dtype=np.uint64))
    a, b = pool[:600], pool[150:750]  # 450 of 750 shared: 0.6
    sig = superminhash(np.concatenate((a, b)), np.repeat([0, 1], 600), 2, 512)
    assert abs((sig[0] == sig[1]).mean() - 0.6) < 0.08
    few = superminhash(pool[:3], np.zeros(3, dtype=np.int64), 1, 64)
    # Each element deals out every position once: with few elements all levels take part, all below m.
    assert (few >> np.uint64(32)).max() < 64
    again = superminhash(pool[:3][::-1], np.zeros(3, dtype=np.int64), 1, 64)
    assert (few == again).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(5, 5), (200, 201)]
    out = components(Stage(spark, "test"), spark.createDataFrame(links, "a long, b long"), "t").collect()
    want = {i: 0 for i in range(1, 41)} | {100 + k: 100 for k in range(1, 30)} | {201: 200}
    assert {r["u"]: r["v"] for r in out} == want


def test_folders_of_a_stage_are_removed(spark):
    kept = Stage(spark, "kept")
    table = kept.put(spark.range(3), "t")
    first = len(Stage.made)
    other = Stage(spark, "other").put(spark.range(5), "t")
    copy = kept.put(other, "copy")
    Stage.clear(first)
    assert len(Stage.made) == first and table.count() == 3 and copy.count() == 5
    with pytest.raises(Exception, match="(?i)not exist|FileNotFound|not found"):
        other.count()
