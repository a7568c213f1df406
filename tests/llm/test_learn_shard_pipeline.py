"""The classifier, the shards, and the pipeline as a whole."""

import os
import random
import sys
import zlib

sys.path.insert(0, os.path.dirname(__file__))

import corpus_pipeline  # noqa: E402
import numpy as np  # noqa: E402
from fixtures import empty, messy, messy_rows, sentence  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from labeltide.llm import quality_classifier as q  # noqa: E402
from labeltide.llm import sharding  # noqa: E402
from labeltide.llm.queries import QUERIES, public_tokenizer  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy_on_the_tables(spark):
    got = QUERIES["op1_nbsvm_quality"](spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.itertuples())
    held = got.merge(labels, on="doc_id").query("held_out")
    assert (held.predicted == held.quality).mean() > max(0.9, held.quality.mean())
    good, bad = (held.score[held.quality == k].to_numpy() for k in (1, 0))
    assert (good[:, None] > bad[None, :]).mean() > 0.95
    assert got.score.between(0, 1).all() and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_dual_descent_meets_the_optimum():
    """The duality gap of the fitted weights closes, and no dual variable leaves its box."""
    rnd = np.random.default_rng(0)
    rows = [np.unique(rnd.integers(0, 50, rnd.integers(1, 12))) for _ in range(120)]
    labels = np.where(rnd.random(120) < 0.5, 1.0, -1.0)
    scale = rnd.normal(size=50)
    w = q.dual_coordinate_descent(rows, labels, scale, cost=0.5, epochs=3000, tolerance=1e-8)
    loss = sum(max(0, 1 - y * (w[x] @ scale[x])) for x, y in zip(rows, labels))
    primal = 0.5 * w @ w + 0.5 * loss
    for _ in range(200):  # no step from the optimum lowers the objective
        v = w + rnd.normal(size=50) * 10 ** rnd.uniform(-6, -1)
        assert 0.5 * v @ v + 0.5 * sum(max(0, 1 - y * (v[x] @ scale[x])) for x, y in zip(rows, labels)) >= primal - 1e-6


def test_classifier_on_messy_rows(spark):
    docs = messy(spark)
    no = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in q.score_quality(docs, no, F.lit(True)).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (3, None), (4, 7)], "doc_id long, quality int")
    got = q.score_quality(docs, some, F.col("_id") % 3 != 1).collect()
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert q.score_quality(empty(spark), some, F.lit(True)).count() == 0


def test_shards_are_even_and_keep_equal_texts_together(spark):
    rnd = random.Random(2)
    rows = [(i, sentence(rnd, rnd.randint(3, 60))) for i in range(1500)] + [(2000 + i, "the same text again") for i in range(300)]
    docs = spark.createDataFrame([r + (1, 2, "x") for r in rows], "doc_id long, text string, shard int, size long, node string").repartition(5)
    got = sharding.shard_rows(docs, shards=13, rows_per_bucket=20).toPandas()
    assert (got.groupby("digest").shard.nunique() == 1).all()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard").slot)
    total = got.groupby("shard")["size"].sum()
    assert sorted(total.index) == list(range(13)) and total.max() < 1.1 * total.mean() and total.min() > 0.9 * total.mean()
    text = dict(rows)
    assert all(r.size == len(text[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
               for r in got[["doc_id", "size", "text_crc32"]].itertuples(index=False))


def test_a_text_larger_than_a_shard_gets_one_of_its_own(spark):
    rows = [(i, f"row {i} " + "x" * 50) for i in range(200)] + [(1000 + i, "copy " * 20) for i in range(300)]
    got = sharding.shard_rows(spark.createDataFrame(rows, "doc_id long, text string"), shards=6).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    own = got[got.doc_id >= 1000].shard.unique()
    assert len(own) == 1 and set(got[got.shard == own[0]].doc_id) == set(range(1000, 1300))
    rest = sizes.drop(own[0])
    assert rest.max() < 1.15 * rest.mean()


def test_shards_of_messy_rows(spark, tmp_path):
    docs = messy(spark)
    got = sharding.shard_rows(docs, shards=5).collect()
    assert len(got) == docs.count() and {r["text_crc32"] for r in got if r["size"] == 16} == {0}
    assert {r["shard"] for r in sharding.shard_rows(docs, shards=None, target_bytes=20_000).collect()} >= {0, 1, 2}
    assert sharding.shard_rows(empty(spark)).count() == 0
    for k, plain in enumerate((docs.select("doc_id", "text", "lang"), docs.withColumns({"shard": F.lit("mine"), "digest": F.lit("own"), "shard_1": F.lit(1)}))):
        placed = sharding.write_shards(plain, str(tmp_path / f"shards{k}"), shards=4)
        back = spark.read.parquet(str(tmp_path / f"shards{k}"))
        assert back.count() == plain.count() == placed.count()
        assert back.columns == [*plain.columns, ("shard", "shard_2")[k]]
        assert sorted(map(str, back.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    one = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    assert {r["shard"] for r in sharding.shard_rows(one, shards=40).collect()} == {0}


def ids(rows):
    rows = rows if isinstance(rows, list) else rows.collect()
    return sorted((r[0] is None, r[0] or 0) for r in rows)


def brute_pipeline(spark, rows, labels, bench):
    """Each stage in plain Python, on its own input; mixing and the last stage are checked against these."""
    from test_near_dedup import brute
    from test_rules_mixing import counts

    kept = [r for r in rows if (c := counts(r[1]))[0] >= 10 and 100 * c[4] <= 20 * c[0]]
    found, root = brute([(r[0], r[1]) for r in kept], 5, 80)
    # Of each group one row with the group's smallest id; which of several such rows does not matter by id.
    unique = [kept[g] for g in sorted(set(root))]
    unique = [(found[root.index(g)][2], *r[1:]) for g, r in zip(sorted(set(root)), unique)]
    clean = [r for r in unique if not any(b in r[1] for b in bench)]
    return kept, unique, clean


def test_pipeline_stage_by_stage(spark, tmp_path):
    rnd = random.Random(6)
    bench = [sentence(rnd, 20) for _ in range(5)]
    rows = [r[:5] for r in messy_rows(seed=9, n=80)]
    near = " ".join(["changed"] + rows[2][1].split(" ")[1:])
    rows += [(None, near, "en", "a", 1), (11, "an unrelated text under a known id " + sentence(rnd, 30), "en", "b", 2)]
    rows += [(500 + k, sentence(rnd, 40) + " " + b + " " + sentence(rnd, 40), "en", "a", 1) for k, b in enumerate(bench)]
    sf = str(tmp_path)
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([r + (1, "z") for r in rows], cols + ", _stays long, _place string").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    steps, docs, names = [], spark.read.parquet(f"{sf}/documents.parquet"), None
    names = docs.columns
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        step(spark, docs, sf).write.parquet(f"{sf}/out-{k}")
        docs = spark.read.parquet(f"{sf}/out-{k}")
        steps.append(docs)
        assert k == 4 or docs.columns == names
    for want, got in zip(brute_pipeline(spark, rows, None, bench), steps):
        assert ids(got) == ids(want)
    mixed = ids(steps[3])
    copies = [r["n"] for r in steps[3].groupBy(*names).count().withColumnRenamed("count", "n").collect()]
    assert set(mixed) <= set(ids(steps[2])) and max(copies) <= 3
    last = steps[4].orderBy("start").collect()
    assert ids(last) == mixed
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(last, last[1:]))
    whole = sorted(map(tuple, corpus_pipeline.run(spark, sf).collect()))
    assert whole == sorted(map(tuple, last)) and public_tokenizer()


def test_pipeline_of_messy_and_empty_tables(spark, tmp_path):
    for name, docs in (("messy", messy(spark)), ("empty", empty(spark))):
        sf = str(tmp_path / name)
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and (out.count() > 0) == (name == "messy")
