import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidemark.llm import common, packing, sharding
from tidemark.llm.queries import QUERIES, TOKENIZER

FOLDER = "/root/testdata/sf0.001"


def check_pieces(rows, ids_of, window=2048):
    """Each id in exactly one piece, sequences gapless from 0; returns the padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        ids = ids_of[r.doc_id]
        assert r.doc_tokens == len(ids) and 0 < r.length
        assert zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32
    for doc, ids in ids_of.items():
        spans = sorted((r.start, r.length) for r in by_doc[doc])
        assert [s for s, _ in spans] == [0, *np.cumsum([n for _, n in spans])[:-1].tolist()]
        assert sum(n for _, n in spans) == len(ids)
    padding = 0
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_query_packs_every_id_once(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    ids = {d.doc_id: [*tokenizer.encode(d.text or "", add_special_tokens=False).ids, 1] for d in docs}
    rows = QUERIES["op1_packing"](spark, FOLDER).collect()
    padding = check_pieces(rows, ids)
    assert padding <= 0.01 * sum(map(len, ids.values()))


def test_odd_documents(odd_documents, no_documents):
    rows = packing.pack_documents(odd_documents, TOKENIZER, batch_tokens=64, with_ids=True).collect()
    tokenizer = Tokenizer.from_file(TOKENIZER)
    got = Counter()
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        got[r.doc_id] += r.length
    want = Counter()
    for d in odd_documents.collect():
        want[d.doc_id] += len(tokenizer.encode(d.text or "", add_special_tokens=False).ids) + 1
    assert got == want
    assert packing.pack_documents(no_documents, TOKENIZER).count() == 0


def test_best_fit_is_the_tightest_window():
    rng = random.Random(3)
    for _ in range(30):
        sizes = np.array([rng.randint(1, 64) for _ in range(rng.randint(0, 60))], np.int64)
        room, want = [], []
        for item in np.argsort(-sizes, kind="stable").tolist():
            fits = [r for r in room if r >= sizes[item]]
            if fits:
                room[room.index(min(fits))] -= sizes[item]
            else:
                room.append(64 - sizes[item])
            want.append(sorted(int(r) for r in room))
        windows = packing.best_fit_decreasing(sizes, 64)
        assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
        assert sorted(64 - int(sizes[w].sum()) for w in windows) == sorted(int(r) for r in room)


def test_plan_has_no_padding_beyond_the_gap():
    rng = random.Random(5)
    for n in (1, 2, 40, 400):
        sizes = np.array([rng.randint(1, 300) for _ in range(n)], np.int64)
        fills = [sum(p[2] for p in s) for s in packing.plan_sequences(sizes, 64, 4)]
        assert all(f <= 64 and (64 - f <= 4 or f & (f - 1) == 0) for f in fills)
        assert sum(fills) == sizes.sum()


def test_word_cache_resets(monkeypatch):
    from pathlib import Path

    import pyarrow as pa

    coder = packing.WordTokenizer(Path(TOKENIZER).read_text(encoding="utf-8"), remember=5)
    tokenizer = Tokenizer.from_file(TOKENIZER)
    for text in ["a b c", "d e f g", "a b c d e f g h i j", "", "a a a"]:
        ids, ends = coder.encode(pa.array([text, None]), 1)
        assert ids.tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 1, 1] and ends[-1] == len(ids)


def test_longest_first_is_balanced():
    rng = random.Random(9)
    sizes = {f"k{i}": rng.randint(1, 1000) for i in range(500)}
    dealt = sharding.longest_first(sizes, 16)
    loads = [0] * 16
    for name, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        # the plain rule: the least load, the lowest shard of equals
        assert dealt[name] == min(range(16), key=lambda s: (loads[s], s))
        loads[dealt[name]] += size


def check_shards(rows, shards=16):
    by_text, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        by_text[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_query_deals_near_equal_bytes(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op2_sharding"](spark, folder).collect()
    docs = {d.doc_id: d.text for d in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {
        i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()
    }
    check_shards(rows)
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert max(loads.values()) <= 1.01 * min(loads.values())


def test_odd_documents_are_dealt(odd_documents, no_documents):
    for options in ({}, {"bundles": 3, "heavy_parts": 4}):
        rows = sharding.deal_shards(odd_documents, **options).collect()
        assert len(rows) == odd_documents.count()
        check_shards(rows)
    assert sharding.deal_shards(no_documents).collect() == []


def test_number_in_key_is_gapless_over_slices(spark):
    from pyspark.sql import functions as F

    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").alias("k"), common.hash63("id").alias("h"))
    rows = common.number_in_key(df, ["k"], [F.col("h")], "at", 3000, width=50).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.k].append((r.h, r.at))
    for pairs in by.values():
        assert [a for _, a in sorted(pairs)] == list(range(len(pairs)))


def test_gram_hashes_tell_runs_apart():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 3, 4000).astype(np.uint64)
    for k in (1, 2, 3, 5, 8, 11):
        hashes = common.gram_hashes(values, k)
        assert len(hashes) == len(values) - k + 1
        runs = {}
        for i, h in enumerate(hashes.tolist()):
            assert runs.setdefault(tuple(values[i : i + k].tolist()), h) == h
        assert len(set(runs.values())) == len(runs)
    assert len(common.gram_hashes(values[:3], 4)) == 0
