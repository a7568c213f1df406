import numpy as np
import pytest
from pyspark.sql import functions as F

from labeltide.operators import augment, blocks, encode, labels, score
from labeltide.plans import evaluate


def test_vocab_encode_pad(spark):
    df = spark.createDataFrame([(1, "a b a c"), (2, "b a"), (3, ""), (4, None), (5, "zz a")],
                               "id long, text string")
    v = encode.build_vocabulary(df, "text", size=2)
    assert [(r.token, r.token_id, r["count"]) for r in v.orderBy("token_id").collect()] == [("a", 2, 4), ("b", 3, 2)]
    e = encode.encode_tokens(df, v, "text")
    got = {r.id: r.input_ids for r in e.collect()}
    assert got == {1: [2, 3, 2, 1], 2: [3, 2], 3: [], 4: [], 5: [1, 2]}
    p = encode.pad_and_mask(encode.truncate_tokens(e, 3), length=3).collect()
    m = {r.id: (r.input_ids, r.attention_mask) for r in p}
    assert m[1] == ([2, 3, 2], [1, 1, 1]) and m[2] == ([3, 2, 0], [1, 1, 0]) and m[3] == ([0, 0, 0], [0, 0, 0])


def test_encode_keeps_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "c"), (None, "a"), (1, "a b")], "id long, text string")
    e = encode.encode_tokens(df, encode.build_vocabulary(df, "text"), "text")
    assert sorted((r.id or 0, r.input_ids) for r in e.collect()) == [(0, [2]), (1, [2, 3]), (1, [2, 3]), (1, [4])]


def test_pad_to_the_longest_of_each_batch(spark):
    df = spark.createDataFrame([(0, [5, 6, 7]), (0, [5]), (1, [8]), (1, []), (None, [9, 9])], "batch long, input_ids array<int>")
    got = sorted((-1 if r.batch is None else r.batch, r.input_ids, r.attention_mask) for r in encode.pad_and_mask(df, batch="batch").collect())
    assert got == [(-1, [9, 9], [1, 1]), (0, [5, 0, 0], [1, 0, 0]), (0, [5, 6, 7], [1, 1, 1]), (1, [0], [0]), (1, [8], [1])]


def test_augment_empty_texts_yield_nothing(spark):
    df = spark.createDataFrame([(1, ""), (2, "  "), (3, None), (4, "a b c d e f")], "id long, text string")
    lex = spark.createDataFrame([("b",)], "token string")
    assert [r.id for r in augment.augment_drop(df, "text", lex).collect()] == [4]
    subs = spark.createDataFrame([("a", "x")], "token string, substitute string")
    assert [r.text for r in augment.augment_replace(df, "text", lex, subs).collect()] == ["x b c d e f"]


def test_classifier_refuses_names_and_takes_numbered_ones(spark):
    rows = [(i, "good fine" if i % 2 else "bad awful", "NOT" if i % 2 else "HOF") for i in range(40)]
    df = spark.createDataFrame(rows, "o long, text string, label string")
    with pytest.raises(ValueError, match="is no number"):
        score.train_text_classifier(df, "text", "label")
    model, dictionary = score.train_named_classifier(df, "text", "label", "o", num_features=64, max_iter=5)
    out = labels.decode_labels(score.apply_classifier(model, df, "text"), dictionary, "prediction", "name")
    assert all(r["name"] == r["label"] for r in out.collect())


def test_weights_as_a_table_score_like_a_matrix(spark):
    """Against numpy over the whole vocabulary; rows without tokens, unknown ids, labels outside the classes, null lists."""
    import random

    rnd = random.Random(3)
    rows = [(i, [rnd.randint(0, 49) for _ in range(rnd.randint(0, 30))], rnd.choice([0, 1, 2, None, 7])) for i in range(1500)]
    rows += [(2000, None, 1), (2001, [49] * 500, None), (2002, [10**6, -1], None)]
    df = spark.createDataFrame(rows, "id long, ids array<int>, c int").repartition(3)
    weights = score.train_token_weights(df, "ids", "c", 3, 50, alpha=0.5)
    got = {r.id: r for r in score.score_by_weights(blocks.blocked(df), weights, "ids").collect()}
    counts, prior = np.zeros((50, 3)), np.zeros(3)
    for _, ids, c in rows:
        if c in (0, 1, 2):
            prior[c] += 1
            for t in ids or []:
                counts[t, c] += 1
    w = np.log((counts + 0.5) / (counts.sum(axis=0) + 25))
    bias, unseen = np.log((prior + 0.5) / (prior.sum() + 1.5)), np.log(0.5 / (counts.sum(axis=0) + 25))
    assert len(got) == len(rows) and set(got[0].asDict()) == {"id", "c", "logits", "prediction"}
    for i, ids, _ in rows:
        want = bias + sum((w[t] if 0 <= t < 50 else unseen for t in ids or []), np.zeros(3))
        assert np.allclose(got[i].logits, want) and got[i].prediction == str(int(np.argmax(got[i].logits)))


def test_no_exchange_carries_a_row_per_token(spark):
    df = spark.createDataFrame([(i, "a b a c " * 50) for i in range(400)], "id long, text string").repartition(2)
    out = encode.encode_tokens(df, encode.build_vocabulary(df, "text"), "text")
    assert all(len(r.input_ids) == 200 for r in out.collect())
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Distinct" in plan or "Aggregate" in plan
    assert "posexplode" not in plan


def test_augment_drop_replace_generate(spark):
    lex = spark.createDataFrame([("hate",)], "token string")
    df = spark.createDataFrame([(1, "a b c d e f", "NOT"), (2, "hate b c d e f", "HOF"),
                                (3, "hate b c d e hate", "HOF"), (4, "a b c", "NOT")],
                               "id long, text string, label string")
    got = {r.id: r.text for r in augment.augment_drop(df, "text", lex).collect()}
    assert got == {1: "b c d e", 2: "hate b c d e"}
    subs = spark.createDataFrame([("a", "A"), ("f", "F"), ("c", "C")], "token string, substitute string")
    rep = {r.id: r.text for r in augment.augment_replace(df, "text", lex, subs).collect()}
    assert rep == {1: "A b c d e F", 2: "hate b c d e F", 4: "A b C"}
    adds = spark.createDataFrame([(1, "x", "hate"), (4, "y", "z")], "id long, tok1 string, tok2 string")
    gen = {r.id: (r.text, r.label) for r in
           augment.augment_generate(df, "text", "label", "id", adds, lex, "HOF").collect()}
    assert gen == {1: ("a b c d e f x hate", "HOF"), 4: ("a b c y z", "NOT")}
    both = augment.with_augmented(df, [augment.augment_drop(df, "text", lex)], ["base", "drop"])
    assert both.count() == 6 and set(both.columns) >= {"source", "source_rank"}


def test_score_batches_and_evaluate(spark):
    rows = [(i, ("good fine nice " if i % 2 else "bad awful hate ") + f"w{i}",
             "NOT" if i % 2 else "HOF") for i in range(200)]
    train = spark.createDataFrame([(str(i), t, l, i) for i, t, l in rows],
                                  "id string, text string, label string, row_ord long")
    test = train.select("id", "text", "row_ord")
    gold = train.select("id", "label")
    preds, report, missing = evaluate.score_and_evaluate(train, test, gold, vocab_size=100)
    r = report.first()
    assert r.accuracy == 1.0 and r.n == 200
    assert missing.count() == 0
    assert set(x.prediction for x in preds.collect()) == {"HOF", "NOT"}


def test_spark_ml_classifier(spark):
    rows = [(i, ("good fine nice" if i % 2 else "bad awful hate"), i % 2) for i in range(100)]
    df = spark.createDataFrame(rows, "id long, text string, label int")
    model = score.train_text_classifier(df, "text", "label", num_features=256, max_iter=20)
    out = score.apply_classifier(model, df, "text").collect()
    assert all(r.prediction == str(r.label) for r in out)
    assert all(abs(sum(r.probability) - 1) < 1e-9 for r in out)


def test_majority_fallback_option(spark):
    rows = [(str(i), "x y" if i % 3 else "z w", "NOT" if i % 3 else "HOF", i) for i in range(60)]
    train = spark.createDataFrame(rows, "id string, text string, label string, row_ord long")
    _, rep, _ = evaluate.score_and_evaluate(train, train.select("id", "text", "row_ord"),
                                            train.select("id", "label"), vocab_size=10,
                                            fallback="majority")
    assert rep.first().n == 60


def test_prepare_corpus_null_modes(spark):
    df = spark.createDataFrame([(1, "A b", "x"), (2, None, "y"), (3, "c", None)],
                               "row_ord long, text string, label string")
    assert evaluate.prepare_corpus(df).count() == 2
    assert evaluate.prepare_corpus(df, drop_nulls="any").count() == 1
    assert evaluate.prepare_corpus(df, drop_nulls="none").count() == 3
    got = evaluate.prepare_corpus(df, dedup_text=True, drop_nulls="any").collect()
    assert [(r.row_ord, r.text) for r in got] == [(1, "a b")]


def test_bigrams_and_seeded_draws(spark):
    """Counts, the first successors, draws in proportion to counts, the same again; a token without a successor is repeated."""
    df = spark.createDataFrame([(1, "a b a b a c"), (2, "a d"), (3, None), (4, ""), (5, "z")], "id long, text string")
    table = {(r.token, r.next): r.n for r in augment.bigram_table(df, "text").collect()}
    assert table == {("a", "b"): 2, ("b", "a"): 2, ("a", "c"): 1, ("a", "d"): 1}
    assert {(r.token, r.next) for r in augment.bigram_table(df, "text", top=2).collect()} == {("a", "b"), ("a", "c"), ("b", "a")}
    bigrams = spark.createDataFrame([("a", "x", 3), ("a", "y", 1)], "token string, next string, n long")
    rows = spark.range(4000).selectExpr("id", "IF(id % 4 = 0, 'q', 'a') AS t")
    got = {r.id: r.o for r in augment.draw_next(rows, "id", "t", bigrams, "o", 5).collect()}
    assert got == {r.id: r.o for r in augment.draw_next(rows.repartition(7), "id", "t", bigrams, "o", 5).collect()}
    assert all(got[i] == "q" for i in range(0, 4000, 4))
    drawn = [got[i] for i in got if i % 4]
    assert 0.7 < drawn.count("x") / len(drawn) < 0.8
