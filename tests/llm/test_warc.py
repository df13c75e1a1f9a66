import base64
import glob
import gzip
import hashlib
import json
from collections import defaultdict

import pytest

from tidemark.llm import warc
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "page_id long, url string, html string, key string, offset int, file int"


def expected(rows):
    last = defaultdict(int)
    for r in rows:
        last[r.html or ""] = max(last[r.html or ""], r.page_id)
    out = []
    for r in rows:
        data = (r.html or "").encode()
        refers = None if r.page_id == last[r.html or ""] else last[r.html or ""]
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((r.page_id, len(data), digest, "response" if refers is None else "revisit", refers))
    return sorted(out)


@pytest.fixture(scope="module")
def pages(stored):
    rows = [(i, f"http://h{i % 7}.example.org/p/{i % 90}?q={i}", f"<p>{'x' * (i % 40)}é</p>", "k", 1, 2) for i in range(400)]
    rows += [(1000 + i, "http://hot.example.org/", f"<b>{i}</b>", None, None, None) for i in range(300)]
    rows += [(2000, None, None, "k", 1, 1), (2001, "", "", "k", 1, 1), (2002, "http://[bad", "🙂" * 3, "k", 1, 1)]
    rows += [(2003, "HTTP://User@Ex.Org:8080\r\nX: y", "z" * 300_000, "k", 1, 1)]
    return stored(rows, SCHEMA, 4)


def test_pages_come_back(pages, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_ROWS", 16)
    captures = warc.write_archives(warc.mark_revisits(pages), str(tmp_path), bytes_per_file=4000)
    shards = warc.write_index(captures, str(tmp_path), block_rows=16)
    got = warc.read_captures(pages.select("page_id", "url"), str(tmp_path), shards).collect()
    assert sorted(tuple(r)[:5] for r in got) == expected(pages.collect())
    assert warc.read_captures(pages.select("page_id", "url"), str(tmp_path), shards, 5).count() == len(got)
    # every archive is a row of gzip members, every index block sorted, and blocks follow each other
    files = glob.glob(f"{tmp_path}/*.warc.gz")
    assert len(files) > 4 and sum(gzip.open(f).read().count(b"WARC/1.1\r\n") for f in files) == pages.count()
    firsts = []
    for row in sorted(shards.collect(), key=lambda r: (r.key, r.page_id)):
        directory = [json.loads(x) for x in open(f"{tmp_path}/{row.shard}.directory")]
        data = open(f"{tmp_path}/{row.shard}.blocks.gz", "rb").read()
        for key, page_id, at, length in directory:
            lines = [json.loads(x) for x in gzip.decompress(data[at : at + length]).decode().splitlines()]
            assert lines[0][:2] == [key, page_id] and len(lines) <= 16
            firsts += [tuple(x[:2]) for x in lines]
    assert firsts == sorted(firsts) and len(firsts) == pages.count()


def test_index_finds_what_is_there_and_nothing_else(pages, tmp_path):
    captures = warc.write_archives(warc.mark_revisits(pages), str(tmp_path))
    shards = warc.write_index(captures, str(tmp_path), block_rows=7)
    index = warc.CaptureIndex(str(tmp_path), [tuple(r) for r in shards.collect()])
    for r in captures.collect():
        assert [c[:2] for c in index.find(r.key, r.page_id)] == [(r.key, r.page_id)]
    assert index.find("org,example,hot)/", 5) == [] and index.find("", -1) == [] and index.find("~", 1) == []


def test_repeated_rows_and_empty_table(stored):
    rows = [(1, "http://a/", "x", None, None, None)] * 3 + [(2, "http://a/", "x", None, None, None)]
    got = warc.archive_pages(stored(rows, SCHEMA)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in got) == [(1, "revisit", 2)] * 3 + [(2, "response", None)]
    got = warc.archive_pages(stored(rows[:3], SCHEMA)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to or 0) for r in got) == [(1, "response", 0)] + [(1, "revisit", 1)] * 2
    assert warc.archive_pages(stored([], SCHEMA)).collect() == []


def test_pages_without_id(stored, tmp_path):
    rows = [(None, "http://a/", "x", None, None, None), (None, "http://a/", "x", None, None, None), (7, "http://a/", "x", None, None, None)]
    rows += [(-5, "http://a/", "z", None, None, None), (None, None, "y", None, None, None), (None, "http://b/", "y", None, None, None), (None, None, None, None, None, None)]
    pages = stored(rows, SCHEMA)
    got = warc.archive_pages(pages, str(tmp_path)).collect()
    assert sorted((r.page_id is not None, r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in got) == [
        (False, 0, 0, "response", 0), (False, 0, 1, "response", 0), (False, 0, 1, "response", 0), (False, 0, 1, "revisit", 7), (False, 0, 1, "revisit", 7),
        (True, -5, 1, "response", 0), (True, 7, 1, "response", 0),
    ]


def test_a_damaged_record_is_not_returned():
    good = warc.record(3, "http://a/", b"payload", None)
    assert warc.checked_record(good)[:2] == ("response", 7)
    for old, new in ((b"payload", b"paYload"), (b"Content-Length: 7", b"Content-Length: 6")):
        with pytest.raises(ValueError, match="urn:page:3"):
            warc.checked_record(gzip.compress(gzip.decompress(good).replace(old, new)))


def test_reads_are_dealt_by_the_size_of_records(spark):
    def tasks(*lengths):
        return warc.read_tasks(spark.createDataFrame([(n,) for n in lengths], "length long"))

    cores = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert tasks() == 1 and tasks(10) == 1 and tasks(3 << 20, 1) == min(cores, 4) and tasks(1 << 40) == 1 << 12


def test_reversed_key():
    assert warc.reversed_key("https://www.Example.org:81/A/b?C=d") == "org,example,www:81)/a/b?c=d"
    assert warc.reversed_key("http://example.org") == "org,example)/"


def test_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    assert sorted(tuple(r) for r in QUERIES["op10_warc_index"](spark, FOLDER).collect()) == expected(rows)
