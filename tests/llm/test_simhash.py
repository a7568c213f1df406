"""SimHash fingerprints and multi-index links against brute force, crowds, messy inputs."""

import os
import random
import re
import sys

sys.path.insert(0, os.path.dirname(__file__))

import numpy as np  # noqa: E402
import pytest  # noqa: E402
import xxhash  # noqa: E402
from fixtures import empty, messy  # noqa: E402

from labeltide.llm.common import Stage  # noqa: E402
from labeltide.llm.simhash_dedup import BITS, fingerprint_links, majority_bits, segment_plan, simhash_duplicates  # noqa: E402


def plain_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[k:k + size]) for k in range(len(words) - size + 1)] if len(words) >= size else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(BITS) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints, radius=4):
    """Per position the smallest position that it reaches by links of at most ``radius`` bits."""
    v, parent = np.array(prints, dtype=np.uint64), list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[:k] ^ v[k]) <= radius):
            a, b = root(k), root(int(j))
            parent[max(a, b)] = min(a, b)
    return [root(k) for k in range(len(v))]


def test_messy_rows(spark):
    docs = messy(spark)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()), key=lambda r: (r[0] is None, r[0] or 0))
    prints = [plain_fingerprint(t) for _, t in rows]
    # Rows are in id order, nulls last: the first row of a group has its smallest id, null only if there is no other.
    want = sorted((str(i), f"{p:016x}", str(rows[g][0])) for (i, _), p, g in zip(rows, prints, groups(prints)))
    got = simhash_duplicates(docs)
    assert got.columns == ["doc_id", "fingerprint", "component_id", "kept"]
    got = got.collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    assert simhash_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("segments,crowd,block", [(None, 64, 2048), (1, 64, 2048), (2, 4, 16), (3, 4, 16), (5, 2, 7)])
def test_links_hold_groups_together(spark, segments, crowd, block):
    """Families around a few centres, chains, and lone values: same groups for every segmentation and block size."""
    rnd, prints = random.Random(7), set()
    for _ in range(6):
        centre = rnd.getrandbits(64)
        for _ in range(40):
            prints.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))))
    walk = rnd.getrandbits(64)
    for _ in range(30):
        walk ^= sum(1 << b for b in rnd.sample(range(64), 4))
        prints.add(walk)
    prints |= {rnd.getrandbits(64) for _ in range(100)} | {0, 1, (1 << 64) - 1}
    prints = sorted(prints)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    if segments == 1:  # the ball of one 64-bit segment at radius 4 is too large to list here
        links, radius = fingerprint_links(Stage(spark, "test"), table, 1, 1), 1
    else:
        links, radius = fingerprint_links(Stage(spark, "test"), table, 4, segments, crowd, block), 4
    place = {p: k for k, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links.collect():
        a, b = place[r["a"] % (1 << 64)], place[r["b"] % (1 << 64)]
        assert (prints[a] ^ prints[b]).bit_count() <= radius
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    assert [root(k) for k in range(len(prints))] == groups(prints, radius)


def test_crowded_values_return_a_forest(spark):
    """All at distance 2 of each other: the links stay near the number of fingerprints, not its square."""
    table = spark.createDataFrame([(1 << k,) for k in range(60)], "fp long")
    links = fingerprint_links(Stage(spark, "test"), table, 4, 3, crowd=4, block=30)
    assert 59 <= links.count() < 800


def test_plan_covers_every_difference():
    for segments in range(1, 6):
        plan = segment_plan(segments, 4) if segments > 1 else []
        shares = [max(m.bit_count() for m in ball) for _, _, ball in plan]
        assert not plan or sum(shares) == 4 - segments + 1
    with pytest.raises(ValueError):
        segment_plan(6, 4)


def test_majority_of_long_documents():
    rnd = np.random.default_rng(1)
    hashes = rnd.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2) + rnd.integers(0, 2, 2000, dtype=np.uint64)
    bounds = np.array([0, 0, 1, 3, 300, 300, 1999, 2000])
    want = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes[i:j]) > j - i) for i, j in zip(bounds, bounds[1:])]
    assert majority_bits(hashes, bounds).tolist() == want
