"""Token files and web archives: exact round trips."""

import gzip
import hashlib
import os
import sys
import zlib

sys.path.insert(0, os.path.dirname(__file__))

import numpy as np  # noqa: E402
import pytest  # noqa: E402
from fixtures import empty, messy  # noqa: E402
from hypothesis import given, settings  # noqa: E402
from hypothesis import strategies as st  # noqa: E402

from labeltide.llm import token_store as t  # noqa: E402
from labeltide.llm import warc as w  # noqa: E402
from labeltide.llm.queries import public_tokenizer  # noqa: E402


def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(public_tokenizer())


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abzAZéßİıΣσς'’.,;:!?-_ \t\n\r\x0b\x0c\x85 　́kK12٣😀中|<>endoftext")), max_size=40))
def test_parts_give_the_library_ids(text):
    encoder = ENCODERS.setdefault("x", t.TextEncoder(public_tokenizer(), True))
    tok = ENCODERS.setdefault("lib", library())
    assert np.frombuffer(encoder.text(text), dtype="<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


ENCODERS: dict = {}


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [1, 7, 64, 100, 129])
def test_plane_file_round_trip(tmp_path, bits, n):
    from pyarrow import fs

    ids = np.random.default_rng(n).integers(0, 1 << (32 if n % 2 else 15), n, dtype=np.uint32)
    store, path = fs.LocalFileSystem(), str(tmp_path / "x.planes")
    with store.open_output_stream(path) as sink:
        writer = t.PlaneWriter(sink, 32, bits, 1)
        for part in np.array_split(ids, 5):
            writer.add(part.astype("<u4").tobytes())
        writer.close()
    reader = t.PlaneReader(store, path)
    assert reader.bits == bits and len(reader.index) == -(-n // 32)
    for a, b in [(0, n), (n // 2, n), (n // 3, n // 2), (n, n)]:
        assert reader.ids(a, b - a).tolist() == ids[a:b].tolist()


def test_tokenizers_whose_tokens_hold_blanks(spark, tmp_path):
    from tokenizers import Tokenizer, models

    signs = {c: k for k, c in enumerate("abAB \n")}
    tok = Tokenizer(models.BPE(vocab={**signs, " a": 6, "b ": 7}, merges=[(" ", "a"), ("b", " ")]))
    tok.save(str(tmp_path / "blanks.json"))
    texts = ["a b a", "A  ab b\na ", " ", None, "aB"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids_crc32"] for r in t.token_table(docs, str(tmp_path / "blanks.json"), end_id=9).collect()}
    assert got == {k: zlib.crc32(np.array(tok.encode(x or "").ids + [9], dtype="<u4").tobytes()) for k, x in enumerate(texts)}


def test_messy_rows_round_trip(spark):
    docs = messy(spark)
    rows = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = t.token_table(docs, public_tokenizer(), chunk_ids=1000).orderBy("start").collect()
    at, tok = 0, library()
    assert len(got) == len(rows)
    for r, (i, text) in zip(got, rows):
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert t.token_table(empty(spark), public_tokenizer()).count() == 0


PAGES = "page_id long, url string, html string, digest string, file string, head long, revisit boolean"


def pages(spark):
    long, other = "<p>é</p>" * 200, "x" * 999
    rows = [(1, "http://a/ü?q=1", long), (5, "http://b/\r\nX: y", long), (3, None, long), (4, "http://c", other), (6, "http://d", other),
            (7, "http://e", None), (8, "http://f", ""), (9, "http://g", "a\r\n\r\nb"), (None, "http://h", long), (None, None, None),
            (10, "http://i", "y" * 1000), (10, "http://i", "y" * 1000), (11, "http://j", "z" * 3_000_000)]
    return spark.createDataFrame([r + ("d", "f", 1, True) for r in rows], PAGES).repartition(3), rows


def test_archive_round_trip(spark):
    df, rows = pages(spark)
    got = sorted(map(tuple, w.archive_digests(df, roll_bytes=500).collect()), key=str)
    head = {}
    for i, _, h in rows:
        if h is not None and len(h.encode()) >= 1000 and i is not None:
            head[h] = max(head.get(h, 0), i)
    want = []
    for i, _, h in rows:
        body, top = (h or "").encode(), head.get(h)
        again = top is not None and i != top
        want.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", top if again else None))
    assert got == sorted(want, key=str)


def test_selected_records_are_read_whole(spark):
    df, rows = pages(spark)
    folder, index = w.write_archives(df)
    some = w.read_archives(folder, index.where("page_id in (9, 11, 5)")).collect()
    assert {r["page_id"]: bytes(r["payload"]) for r in some} == {i: h.encode() for i, _, h in rows if i in (9, 11, 5)}
    assert all("\r" not in (r["url"] or "") for r in some)
    # Every file is a run of gzip members that any reader of archives can walk through.
    path = folder.removeprefix("file:")
    whole = b"".join(gzip.open(os.path.join(path, f)).read() for f in os.listdir(path) if f.endswith(".warc.gz"))
    assert whole.count(b"WARC/1.1\r\n") == len(rows)
    nothing = spark.createDataFrame([], PAGES)
    assert w.archive_digests(nothing).count() == 0


def test_ranges_are_merged():
    rows = [("b", 0, 10), ("a", 100, 10), ("a", 0, 50), ("a", 60, 40), ("a", 5000, 10)]
    got = [(f, a, b, sorted(m)) for f, a, b, m in w.merge_ranges(rows, 16, 1000)]
    assert got == [("a", 0, 110, [1, 2, 3]), ("a", 5000, 5010, [4]), ("b", 0, 10, [0])]


def test_damaged_record_is_refused():
    good = w.build_record(1, "http://a", b"body", hashlib.sha1(b"body").hexdigest(), None, False, "2024-01-01T00:00:00Z")
    assert w.parse_record(good)["payload"] == b"body"
    with pytest.raises(ValueError):
        w.parse_record(good.replace(b"body", b"bodx"))
