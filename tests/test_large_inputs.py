"""Steps that grew faster than, or cost far more than, their input: who does the work, and that the rows are right."""

import os
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labeltide import session
from labeltide.functions import text as X
from labeltide.operators import blocks, encode, prepare, score
from labeltide.plans import evaluate
from labeltide.plans.catalog import QUERIES
from labeltide.sources import registry


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tables"))
    n = F.col("doc_id")
    docs = spark.range(0, 240, numPartitions=4).select(F.col("id").alias("doc_id")).select(
        "doc_id", F.concat_ws(" ", F.lit("the common word"), F.concat(F.lit("w"), F.translate((n % 7).cast("string"), "0123456", "abcdefg")),
                              F.when(n % 5 == 0, F.lit('a "quoted", line\nmore'))).alias("text"),
        F.lit("en").alias("lang"), F.concat(F.lit("s"), (n % 3).cast("string")).alias("source"))
    docs.write.parquet(f"{base}/documents.parquet")
    docs.select("doc_id", (n % 2).cast("int").alias("toxic"), (n % 3).cast("int").alias("quality")).write.parquet(f"{base}/labels.parquet")
    return base


def test_swapped_headers_are_written_by_all_tasks(spark, tables):
    rows = {r.doc_id: r for r in QUERIES["csv_swapped_headers"](spark, tables).collect()}
    folder = [p for p in session._SCRATCH if "labeltide-swapped" in p][-1].removeprefix("file:")
    assert len([f for f in os.listdir(folder) if f.endswith(".csv")]) > 3
    for r in spark.read.parquet(f"{tables}/documents.parquet").collect():
        assert (rows[r.doc_id].text, rows[r.doc_id].lang) == (r.text, "en")
        assert rows[r.doc_id].source == (r.source if r.doc_id % 3 == 2 else None)


def test_padding_does_not_encode_again(spark, tables):
    out = QUERIES["pad_and_mask"](spark, tables)
    assert "FlatMapCoGroupsInArrow" not in _plan(out)
    sizes = {r.doc_id: len(r.t) for r in spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", X.tokens(X.clean_text(F.col("text"))).alias("t")).collect()}
    for r in out.collect():
        mates = range(r.batch * 16, r.batch * 16 + 16)
        assert r.doc_id in mates and (r.width, r.n_tokens) == (max(sizes[m] for m in mates), sizes[r.doc_id])


def test_widths_come_without_a_join(spark):
    df = spark.createDataFrame([(0, [5, 6]), (0, [7]), (None, [8]), (None, [])], "batch int, input_ids array<int>")
    out = encode.pad_and_mask(df, batch="batch")
    assert "Join" not in _plan(out)
    assert sorted((r.batch is None, r.input_ids, r.attention_mask) for r in out.collect()) == [
        (False, [5, 6], [1, 1]), (False, [7, 0], [1, 0]), (True, [0], [0]), (True, [8], [1])]


def test_tasks_of_olid_count_tokens_without_a_row_for_each(spark, tables):
    vocab = encode.build_vocabulary(spark.read.parquet(f"{tables}/documents.parquet"), "text", size=5)
    assert "Generate" not in _plan(vocab)
    found = {r.task: r for r in QUERIES["olid_tasks"](spark, tables).collect()}
    assert all((r.n, r.written, r.unmatched) == (80, 80, 0) for r in found.values()) and set(found) == {"a", "b"}


def test_tasks_of_olid_share_files_and_texts(spark, tables):
    before = len(session._SCRATCH)
    QUERIES["olid_tasks"](spark, tables)
    made = Counter(re.sub(r"-[0-9a-f]{32}$", "", os.path.basename(p)) for p in session._SCRATCH[before:])
    assert made["splits"] == 3 + 2 + 1  # train, dev and test; a gold file per task; the predictions
    assert made["vocabulary"] == made["encoded"] == made["scored"] == 1


@pytest.mark.parametrize("gap", [False, True])
def test_tasks_fitted_together_are_as_fitted_alone(spark, gap):
    def text(k):
        return " ".join(f"w{'abcdefghijk'[k * j % 11]}" for j in range(1, 2 + k % 5)) + (" only" if k % 10 == 3 else "")

    train = spark.createDataFrame([(k, str(k), text(k) if k % 7 else None, "xy"[k % 2], None if gap and k % 10 == 3 else "pqr"[k % 3]) for k in range(60)],
                                  "row_ord long, id string, text string, label_a string, label_b string")
    test = spark.createDataFrame([(str(k), text(k) + " never") for k in range(40)] + [("n", None)], "id string, text string")
    both = evaluate.fit_and_score_tasks(train, test, ["label_a", "label_b"])
    for col, (scored, dictionary, rows) in zip(("label_a", "label_b"), both):
        alone, own, alone_rows = evaluate.fit_and_score(train, test, label_col=col)
        assert sorted(dictionary.collect()) == sorted(own.collect()) and rows.count() == alone_rows.count()
        want = {r.id: r for r in alone.collect()}
        got = {r.id: r for r in scored.collect()}
        assert set(got) == set(want) and len(got) == 41
        for i, r in got.items():
            assert r.logits == pytest.approx(want[i].logits, rel=1e-12) and r.pred_id == want[i].pred_id


def test_blocks_hold_the_tokens_of_str_split(monkeypatch):
    odd = ["a  b\x1ca c", None, "", "  \n", " lead", "trail\u2003", "x\x85y\xa0z\u3000x", "é\u200bé é", "w " * 40]
    raw = [t and t.encode() for t in odd] + [b"bad \xff\xed\xa0\x80 utf"]
    for size in (1 << 25, 64, 1):
        monkeypatch.setattr(encode, "BLOCK_BYTES", size)
        for texts in (raw, raw[:-1], raw[:1], raw[1:2], []):
            found, at = [], 0
            for first, n, words, places, ends in encode._blocks_of(pa.array(texts, pa.binary())):
                assert first == at and len(ends) == n and len(set(words.to_pylist())) == len(words)
                at += n
                tokens = [words[p].as_py() for p in places]
                found += [tokens[a:b] for a, b in zip([0, *ends[:-1]], ends)]
            assert at == len(texts) and found == [t.decode("utf-8", "replace").split() if t else [] for t in texts]


def test_scoring_looks_up_by_the_blocks_of_the_encoding(spark):
    df = spark.createDataFrame([(k, f"a b w{k} w{k % 50}") for k in range(4000)], "id int, text string").repartition(1)
    vocab = session.stored(encode.build_vocabulary(df, "text"), "vocabulary")
    out = encode.encode_tokens(df, vocab, "text", keep_block=True)
    assert "ShuffledHashJoin" in _plan(out)
    rows = blocks.blocked(out)
    assert rows.select(blocks.BLOCK).distinct().count() == 1 and rows.count() == 4000
    coded = spark.read.parquet([p for p in session._SCRATCH if "/tokens-" in p][-1])
    assert coded.agg(F.max(F.size("__words"))).first()[0] == 2  # 4,002 tokens of one block on 4,000 rows
    table = vocab.select("token_id", F.array(F.col("token_id").cast("double"), F.lit(0.0)).alias("weights"))
    scored = score.score_by_weights(rows, score.TokenWeights(table, [0.0, 0.0], [0.0, 1.0]), "input_ids")
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert {r.id: r.logits for r in scored.collect()} == {
        k: [float(sum(ids[w] for w in f"a b w{k} w{k % 50}".split())), 1.0] for k in range(4000)}


def test_weights_are_looked_up_by_entries_found_in_place(spark):
    data = [(k, [k % 5, k % 5, 7] if k % 3 else None) for k in range(1500)]
    rows = blocks.blocked(spark.createDataFrame(data, "doc_id int, input_ids array<int>").repartition(3))
    table = spark.createDataFrame([(k, [float(k), -float(k)]) for k in range(4)], "token_id int, weights array<double>")
    out = score.score_by_weights(rows, score.TokenWeights(table, [0.25, 0.5], [1.0, 2.0]), "input_ids")
    assert "Generate" not in _plan(out)
    known = {k: (k, -k) for k in range(4)}
    for r in out.collect():
        ids = data[r.doc_id][1] or []
        want = [b + sum(known.get(i, (0.25, 0.5))[c] for i in ids) for c, b in enumerate((1.0, 2.0))]
        assert r.logits == pytest.approx(want) and r.prediction == str(int(want[1] > want[0]))


def test_encoding_moves_places_and_reading_sorts_no_rows(spark, tmp_path):
    texts = ["a  b\x1ca c", None, "", "  \n", "b", "unseen\x85a"]
    data = [(k % 50, f"s{k % 2}", texts[k % 6] and f"{texts[k % 6]} w{k % 977}") for k in range(5000)]
    df = spark.createDataFrame(data, "id int, source string, text string").repartition(2)
    count = Counter(w for _, _, t in data for w in (t or "").split())
    vocab = {r.token: r for r in encode.build_vocabulary(df, "text").collect()}
    order = sorted(count, key=lambda w: (-count[w], w))
    assert {w: (r.token_id, r["count"]) for w, r in vocab.items()} == {w: (k + 2, count[w]) for k, w in enumerate(order)}
    known = spark.createDataFrame([(w, r.token_id) for w, r in vocab.items() if w != "unseen"], "token string, token_id int")
    out = encode.encode_tokens(df, known, "text", keep_text=True)
    assert "__places:array<int>" in _plan(out) and "array_distinct" not in _plan(out)
    got = Counter((r.id, r.source, r.text, tuple(r.input_ids)) for r in out.collect())
    assert got == Counter((i, s, t, tuple(1 if w == "unseen" else vocab[w].token_id for w in (t or "").split())) for i, s, t in data)

    for k, rows in enumerate((["1,x,HOF", "2,y,NOT"], ["2,y,NOT", "3,z,HOF"], ["9,q,NOT"])):
        (tmp_path / f"{k}.csv").write_text("\n".join(["_id,text,task_1", *rows]) + "\n")
    train, _, _ = registry.load(spark, "hasoc", {"train": [f"{tmp_path}/1.csv", f"{tmp_path}/0.csv"], "dev": f"{tmp_path}/2.csv"}, task="1")
    assert "SortAggregate" not in _plan(train)
    assert sorted(tuple(r) for r in train.select("row_ord", "id", "source").collect()) == [
        (0, "2", "hasoc:train:0"), (1, "3", "hasoc:train:0"), (2, "1", "hasoc:train:1")]


def test_first_rows_bring_the_columns_along(spark):
    df = spark.createDataFrame([("x", 3, 1), ("x", 1, 0), ("y", 2, 0), (None, 5, 1), (None, 4, 1)], "t string, o long, part int")
    assert sorted(map(tuple, prepare.dedup_rows(df, "o", along=["part"]).collect()), key=str) == [("x", 1, 0), ("y", 2, 0), (None, 4, 1)]


def test_guarded_cleaning_equals_the_steps(spark):
    texts = [None, "", "@", "a@", "me@x.org, you", "at 1.2.3.4. and 999.1.2.3.4", "1.2.3.4", "x1.2.3.4\n", "256.1.1.1.", "٣.1.2.3.4.", "no digits. none@all", "a.b@c 10.0.0.1. http://x@y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", X.clean_text(F.col("t")).alias("a"), X.clean_text_stepwise(F.col("t")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert re.search("@", X._EMAIL_FAST)
