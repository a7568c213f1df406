import os
import tempfile

from pyspark.sql import functions as F

import __spark_entry__ as E
from labeltide.operators import score
from labeltide.streaming import files as S


def test_entry_contract(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == ["label", "n"] and rows
    assert set(E.oracle_sql()) <= set(E.queries())
    own = set(E.QUERIES)
    assert own - set(E.oracle_sql()) == {"train_classifier"}


def test_core_queries_without_the_training_data_part(tmp_path):
    """With both folders and the pipeline left out, and with a library missing that only they use, the core queries are all there."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(E.__file__))
    shutil.copytree(os.path.join(root, "labeltide"), tmp_path / "labeltide", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(E.__file__, tmp_path)
    count = "import __spark_entry__ as E; print(len(E.queries()), len(E.oracle_sql()), sum(q.startswith('op') for q in E.queries()))"
    bare = subprocess.run([sys.executable, "-c", count], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": ""})
    assert bare.returncode == 0, bare.stderr
    n, m, _ = map(int, bare.stdout.split())
    names = set(E.QUERIES)
    assert n == len(names) and m == len(names) - 1
    blocked = "import sys; sys.modules['zstandard'] = None; " + count
    missing = subprocess.run([sys.executable, "-c", blocked], cwd=root, capture_output=True, text=True)
    assert missing.returncode == 0 and int(missing.stdout.split()[0]) == len(names) and "zstandard" in missing.stderr


def test_file_stream_scoring(spark):
    base = tempfile.mkdtemp(prefix="labeltide-stream-")
    src = os.path.join(base, "in")
    os.makedirs(src)
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("_id,text\n1,Good fine NICE!\n2,bad awful hate\n3,NA\n")
    train = spark.createDataFrame(
        [(i, "good fine nice" if i % 2 else "bad awful hate", i % 2) for i in range(60)],
        "id long, text string, label int")
    model = score.train_text_classifier(train, "text", "label", num_features=64, max_iter=10)
    q = S.start_scoring(spark, src, os.path.join(base, "out"), os.path.join(base, "ckpt"),
                        model, ["_id", "text"], available_now=True)
    q.awaitTermination(120)
    out = {r["_id"]: r.prediction for r in spark.read.parquet(os.path.join(base, "out")).collect()}
    assert out == {"1": "1", "2": "0"}
