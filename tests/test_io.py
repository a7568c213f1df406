import os
import tempfile

import pytest
from pyspark.sql import functions as F

from labeltide.sinks import writers
from labeltide.sources import delimited, registry


def _write(path, data: bytes):
    with open(path, "wb") as f:
        f.write(data)
    return path


@pytest.fixture
def tmp():
    return tempfile.mkdtemp(prefix="labeltide-io-")


def test_reader_edge_cases(spark, tmp):
    body = ('id,text,label\n1,"he said ""x"", ok\nline2",NULL\n2,,NONE\n3,"",NA\n'
            '4,null,None\n5,caf\xe9,X\n').encode("latin-1")
    p = _write(os.path.join(tmp, "a.csv"), body)
    df = delimited.read_csv(spark, p, encoding=delimited.LATIN1)
    rows = {r.id: r for r in df.collect()}
    assert rows["1"].text == 'he said "x", ok\nline2' and rows["1"].label is None
    assert rows["2"].text is None and rows["2"].label == "NONE"
    assert rows["3"].text is None and rows["3"].label is None
    assert rows["4"].text is None and rows["4"].label is None
    assert rows["5"].text == "café"
    assert sorted(r.row_ord for r in df.collect()) == sorted(set(r.row_ord for r in df.collect()))


def test_tsv_latin1_headerless_and_gold(spark, tmp):
    p = _write(os.path.join(tmp, "t.tsv"),
               "text\tHS\nbonjour \xe0 tous\t1\nsecond\t\n".encode("latin-1"))
    df = delimited.read_tsv(spark, p, latin1=True, types={"HS": "int"})
    got = sorted((r.text, r.HS) for r in df.collect())
    assert got == [("bonjour à tous", 1), ("second", None)]
    q = _write(os.path.join(tmp, "pcl.tsv"), b"1\t@@7\tkw\tus\tsome text\n2\t@@8\tkw\tgb\tmore\n")
    h = delimited.read_delimited(spark, q, sep="\t", header=False,
                                 names=["tno", "art_id", "keyword", "country_code", "text"])
    assert sorted(r.art_id for r in h.collect()) == ["@@7", "@@8"]
    g = _write(os.path.join(tmp, "gold.csv"), b"10,OFF\n11,NOT\n")
    gold = registry.load_gold(spark, g)
    assert sorted(tuple(r) for r in gold.collect()) == [("10", "OFF"), ("11", "NOT")]


def test_registry_load_harmonises(spark, tmp):
    tr = _write(os.path.join(tmp, "tr.csv"),
                b"_id,text,task_1,task_2\na,Hello @you,HOF,PRFN\nb,Bye,NOT,NONE\nb,Bye,NOT,NONE\n")
    dv = _write(os.path.join(tmp, "dv.csv"), b"_id,text,task_1,task_2\nc,Hi,NOT,NONE\n")
    te = _write(os.path.join(tmp, "te.csv"), b"_id,text\nd,Test me\n")
    au = _write(os.path.join(tmp, "au.csv"), b"_id,text,task_1,task_2\ne,Extra,HOF,HATE\n")
    train, dev, test = registry.load(spark, "hasoc", {"train": tr, "dev": dv, "test": te,
                                                      "augment": au}, task="2", augment=True)
    assert train.columns == ["row_ord", "id", "text", "label", "task", "source"]
    assert sorted((r.id, r.label) for r in train.collect()) == [("a", "PRFN"), ("b", "NONE"), ("e", "HATE")]
    assert [r.label for r in test.collect()] == [None]
    assert dev.count() == 1
    _, _, empty = registry.load(spark, "trol", {"train": tr, "dev": dv})
    assert empty.count() == 0 and empty.columns == train.columns
    with pytest.raises(ValueError):
        registry.load(spark, "hateval", {"train": tr, "dev": dv})
    with pytest.raises(ValueError):
        registry.load(spark, "semb", {"train": tr, "dev": tr})


def test_registry_forward_fill_and_combined(spark, tmp):
    a = _write(os.path.join(tmp, "s1.tsv"), b"id\ttext\tHS\n1\tx\t1\n2\ty\t\n3\t\t0\n")
    b = _write(os.path.join(tmp, "s2.tsv"), b"id\ttext\tHS\n9\tz\t1\n")
    train, dev, _ = registry.load(spark, "sema", {"train": a, "dev": b})
    got = sorted((r.text, r.label) for r in train.collect())
    assert got == [("x", "1"), ("y", "0"), ("y", "1")]
    tr1 = _write(os.path.join(tmp, "h1.csv"), b"_id,text,task_1,task_2\na,one,HOF,HATE\n")
    tr2 = _write(os.path.join(tmp, "h2.csv"), b"_id,text,task_1,task_2\nb,two,NOT,NONE\n")
    dv = _write(os.path.join(tmp, "h3.csv"), b"_id,text,task_1,task_2\nc,three,NOT,NONE\n")
    comb, _, _ = registry.load(spark, "hasoc", {"train": [tr1, tr2], "dev": dv})
    rows = comb.orderBy("row_ord").collect()
    assert [r.id for r in rows] == ["a", "b"]


def test_sinks(spark, tmp):
    df = spark.createDataFrame([(2, "NOT", "t1"), (1, "HOF", "t1"), (3, "", "t2")],
                               "row_ord long, prediction string, task string")
    writers.write_predictions(df, os.path.join(tmp, "pred"))
    back = spark.read.option("header", True).csv(os.path.join(tmp, "pred"))
    assert sorted(r.task for r in back.collect()) == ["t1", "t1", "t2"]
    writers.write_prediction_lines(df, os.path.join(tmp, "lines"))
    files = sorted(f for f in os.listdir(os.path.join(tmp, "lines")) if f.startswith("part-"))
    text = "".join(open(os.path.join(tmp, "lines", f)).read() for f in files)
    assert text.splitlines() == ["HOF", "NOT", ""]
    hist = spark.createDataFrame([("r", 1, 0.5, 0.4, 0.7, 0.6)],
                                 "run string, epoch int, train_loss double, val_loss double, "
                                 "f1_weighted double, f1_macro double")
    writers.append_metrics(hist, os.path.join(tmp, "hist"))
    writers.append_metrics(hist.withColumn("epoch", F.lit(2)), os.path.join(tmp, "hist"))
    writers.append_metrics(hist.withColumn("val_loss", F.lit(0.3)), os.path.join(tmp, "hist"))  # the first run again
    back = spark.read.parquet(os.path.join(tmp, "hist"))
    assert sorted((r.epoch, r.val_loss) for r in back.collect()) == [(1, 0.3), (2, 0.4)]
    tr = df.select("row_ord", "prediction")
    writers.write_splits(tr, tr, os.path.join(tmp, "splits"))
    assert spark.read.parquet(os.path.join(tmp, "splits")).where("split = 'dev'").count() == 3


def test_row_order_follows_file_names_not_split_sizes(spark, tmp):
    base = os.path.join(tmp, "many")
    os.makedirs(base, exist_ok=True)
    for k, n in enumerate((2, 400, 50)):  # the largest is read first by Spark's packing
        _write(os.path.join(base, f"part-{k}.csv"), ("text\n" + "".join(f"f{k}r{i}\n" for i in range(n))).encode())
    for multiline in (True, False):
        rows = sorted((r.row_ord, r.text) for r in delimited.read_csv(spark, base, multiline=multiline).collect())
        assert rows == list(enumerate([f"f{k}r{i}" for k, n in enumerate((2, 400, 50)) for i in range(n)]))


def test_paths_are_united_by_column_name(spark, tmp):
    a = _write(os.path.join(tmp, "ab.csv"), b"a,b\n1,2\n")
    b = _write(os.path.join(tmp, "ba.csv"), b"b,a\n4,3\n6,5\n")
    rows = delimited.read_csv(spark, [b, a]).orderBy("row_ord").collect()
    assert [(r.a, r.b, r.row_ord) for r in rows] == [("3", "4", 0), ("5", "6", 1), ("1", "2", 2)]


def test_bad_numbers_become_null_and_are_counted(spark, tmp):
    p = _write(os.path.join(tmp, "bad.csv"), b"n\n1\nx\n\n3\n")
    assert [r.n for r in delimited.read_csv(spark, p, types={"n": "int"}).orderBy("row_ord").collect() if r.n] == [1, 3]
    assert delimited.count_cast_losses(delimited.read_csv(spark, p), {"n": "int"}).first().n == 1


def test_combined_files_are_deduplicated_over_all_of_them(spark, tmp):
    a = _write(os.path.join(tmp, "t1.csv"), b"Text,Sub-task A\none,NAG\ntwo,CAG\n")
    b = _write(os.path.join(tmp, "t2.csv"), b"Text,Sub-task A\ntwo,CAG\nthree,OAG\n")
    c = _write(os.path.join(tmp, "t3.csv"), b"Text,Sub-task A\none,NAG\nfour,OAG\n")
    d = _write(os.path.join(tmp, "t4.csv"), b"Text,Sub-task A\nfive,NAG\n")
    train, _, _ = registry.load(spark, "trol", {"train": [a, b], "dev": d, "augment": c}, augment=True)
    rows = train.orderBy("row_ord").collect()
    assert [(r.text, r.source) for r in rows] == [("one", "trol:train:0"), ("two", "trol:train:0"), ("three", "trol:train:1"), ("four", "trol:augment")]
    assert len({r.id for r in rows}) == 4  # no id column: the row number over all files
    from labeltide.operators import encode
    assert encode.encode_tokens(train, encode.build_vocabulary(train, "text"), "text").count() == 4


def test_remaining_layouts(spark, tmp):
    hos = _write(os.path.join(tmp, "hos.csv"), b"tweet,hate_speech\nx,1\n")
    dev = _write(os.path.join(tmp, "hos_d.csv"), b"tweet,hate_speech\ny,0\n")
    assert [(r.text, r.label) for r in registry.load(spark, "hos", {"train": hos, "dev": dev})[0].collect()] == [("x", "1")]
    lines = "".join(f"{i},t{i},{'OFF' if i % 2 else 'NOT'},,\n" for i in range(20))
    olid = _write(os.path.join(tmp, "olid.csv"), f"id,tweet,subtask_a,subtask_b,subtask_c\n{lines}".encode())
    test = _write(os.path.join(tmp, "olid_t.tsv"), b"id\ttweet\n77\thello\n")
    train, dev, t = registry.load(spark, "olid", {"train": olid, "test": test}, task="a", dev_frac=0.25)
    assert (train.count(), dev.count()) == (15, 5) and [(r.id, r.text) for r in t.collect()] == [("77", "hello")]
    assert {r.id for r in train.collect()} | {r.id for r in dev.collect()} == {str(i) for i in range(20)}
    pcl = _write(os.path.join(tmp, "pcl.csv"), b"text,label\na,0\nb,1\nc,0\nd,1\n")
    ptest = _write(os.path.join(tmp, "pcl_t.tsv"), b"1\t@@7\tkw\tus\tsome text\n")
    train, dev, t = registry.load(spark, "pcl", {"train": pcl, "test": ptest}, dev_frac=0.5)
    assert (train.count(), dev.count()) == (2, 2) and [(r.id, r.text) for r in t.collect()] == [("@@7", "some text")]
    with pytest.raises(ValueError):
        registry.load(spark, "pcl", {"train": pcl, "dev": pcl}, dev_frac=0.5)


def test_folder_whose_files_order_their_columns_differently(spark, tmp):
    base = os.path.join(tmp, "swapped")
    os.makedirs(base, exist_ok=True)
    _write(os.path.join(base, "a.csv"), b"id,text\n1,hello\n")
    _write(os.path.join(base, "b.csv"), b"text,id,more\nworld,2,x\n")
    for multiline in (True, False):
        df = delimited.read_csv(spark, base, multiline=multiline)
        assert df.columns == ["id", "text", "more", "row_ord"]
        assert [tuple(r) for r in df.orderBy("row_ord").collect()] == [("1", "hello", None, 0), ("2", "world", "x", 1)]
        with pytest.raises(ValueError):
            delimited.read_csv(spark, base, names=["more"], multiline=multiline)


def test_headerless_paths_are_numbered_as_listed(spark, tmp):
    z, b = (_write(os.path.join(tmp, f"{n}.tsv"), body) for n, body in (("z", b"1\tx\n2\ty\n"), ("b", b"3\tw\n")))
    for multiline in (True, False):
        rows = delimited.read_delimited(spark, [z, b], sep="\t", header=False, names=["id", "label"], multiline=multiline).orderBy("row_ord").collect()
        assert [(r.id, r.row_ord) for r in rows] == [("1", 0), ("2", 1), ("3", 2)]


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "257b")
    spark.conf.set("spark.sql.files.openCostInBytes", "1b")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _wild_csv(rnd, n, sep=","):
    """Fields with separators, doubled quotes, line ends, stray quotes; some records span several splits."""
    out = []
    for k in range(n):
        body = rnd.choice(["plain", 'say ""hi""', "a\nb", "x\r\ny\n\n", f"one{sep}two", "", '""', "end\n", "w " * rnd.randint(0, 300), "é\n" * rnd.randint(0, 90)])
        loose = rnd.choice(["", "z", '5" pipe', "it''s", 'a "b" c'])
        out.append(f'{k}{sep}"{body}"{sep}{loose}{sep}{rnd.randint(0, 9)}')
    return "id{0}text{0}loose{0}last\n".format(sep) + "\n".join(out) + "\n"


def test_records_of_split_files_equal_the_whole_file_read(spark, tmp, small_splits):
    """Every file is cut into many splits; Spark's one-task multiLine reader is the measure."""
    import random

    for k, sep in enumerate((",", "\t", ",")):
        base = os.path.join(tmp, f"wild{k}")
        os.makedirs(base, exist_ok=True)
        for f in range(2):
            _write(os.path.join(base, f"{f}.csv"), _wild_csv(random.Random(10 * k + f), 60, sep).encode())
        whole = (spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').csv(base))
        lines = spark.read.option("lineSep", "\n").text(base)
        assert lines.rdd.getNumPartitions() >= 8
        df = delimited.read_csv(spark, base, null_tokens=None) if sep == "," else delimited.read_tsv(spark, base, null_tokens=None)
        key = lambda r: tuple(str(x).replace("\r\n", "\n") for x in r)
        assert sorted(key(r) for r in df.drop("row_ord").collect()) == sorted(key(r) for r in whole.collect())
        got = df.orderBy("row_ord").collect()
        assert [r.row_ord for r in got] == list(range(120)) and [r.id for r in got] == [str(i) for i in range(60)] * 2


def test_states_of_lines():
    from labeltide.sources.records import state_after

    for line, out, inside in ((b"a,b", False, True), (b'a,"b', True, False), (b'"a""b",c', False, False), (b'a"b,c"', False, False),
                              (b'x",y', False, False), (b'x","y', True, True), (b'x""y', False, True), (b'"', True, False), (b'""', False, True), (b"", False, True)):
        assert (state_after(line, False, b","), state_after(line, True, b",")) == (out, inside), line
