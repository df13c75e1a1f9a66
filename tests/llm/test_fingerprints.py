import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import winnow
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def selected(text, gram, window):
    """(hash, place) of the rightmost least gram of each window."""
    if not text:
        return []
    data = text.encode("utf-32-be")
    hashes = [xxhash.xxh64_intdigest(data[4 * i : 4 * i + 4 * gram], seed=42) >> 32 for i in range(max(1, len(text) - gram + 1))]
    out = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i : i + window]
        place = i + max(j for j, h in enumerate(part) if h == min(part))
        if (hashes[place], place) not in out[-1:]:
            out.append((hashes[place], place))
    return out


def written(picks):
    return " ".join(f"{h:X}@{p}" for h, p in picks)


def likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def expected(docs, gram, window):
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] or ""))
    texts = [t or "" for _, t in docs]
    out = []
    for i, (doc, _) in enumerate(docs):
        text, following = texts[i], texts[(i + 1) % len(texts)]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        a, b, c = (selected(t, gram, window) for t in (text, edited, following))
        sha = hashlib.sha256(edited.encode()).hexdigest()
        out.append((doc, len(text), sha, written(a), written(b), likeness(a, b), likeness(a, c)))
    return out


def same(got, want):
    order = lambda r: (r[0] is not None, r[0] or 0, r[3], r[4])
    got, want = sorted((tuple(r) for r in got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:])


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    same(QUERIES["op5_fingerprints"](spark, FOLDER).collect(), expected(docs, winnow.GRAM, winnow.WINDOW))


@pytest.mark.parametrize(("gram", "window", "block"), [(3, 4, 8), (2, 7, 5), (5, 1, 64)])
def test_small_grams_blocks_and_ties(spark, stored, gram, window, block):
    rng = random.Random(gram)
    texts = ["".join(rng.choice("ab🙂") for _ in range(rng.choice([0, 1, 2, 3, 4, 5, 9, 30, 90]))) for _ in range(60)]
    docs = [(i * 3, t) for i, t in enumerate(texts)] + [(1000, None)]
    rows = stored(docs, "doc_id long, text string")
    same(winnow.fingerprints(rows, gram=gram, window=window, block=block).collect(), expected(docs, gram, window))


def test_odd_documents(odd_documents, no_documents):
    docs = [(r.doc_id, r.text) for r in odd_documents.collect()]
    same(winnow.fingerprints(odd_documents).collect(), expected(docs, winnow.GRAM, winnow.WINDOW))
    assert winnow.fingerprints(no_documents).collect() == []


def test_one_document_follows_itself(stored):
    docs = [(7, "abcdefgh" * 20)]
    same(winnow.fingerprints(stored(docs, "doc_id long, text string")).collect(), expected(docs, winnow.GRAM, winnow.WINDOW))


def test_least_greatest_and_close_ids(stored):
    """Ids that a double cannot tell apart, at both ends of a long, and nulls before the least one."""
    least, most = -(2**63), 2**63 - 1
    rng = random.Random(3)
    text = lambda: "".join(rng.choice("abcdef ") for _ in range(200))
    docs = [(i, text()) for i in [*range(least, least + 60), *range(2**62, 2**62 + 60), *range(most - 60, most + 1)]]
    docs += [(None, "b"), (None, "a" * 300)]
    rng.shuffle(docs)
    got = winnow.fingerprints(stored(docs, "doc_id long, text string")).collect()
    ordered = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    following = dict(zip(ordered, [*ordered[1:], ordered[0]], strict=True))
    want = []
    for (i, t), (_, after) in following.items():
        cut = len(t) // 4
        want.append((i, hashlib.sha256((t[: len(t) - cut] + after[:cut]).encode()).hexdigest()))
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=repr) == sorted(want, key=repr)


def test_shared_passage_shares_a_hash(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = []
    for _ in range(40):
        passage = text(winnow.GRAM + winnow.WINDOW - 1)
        rows.append((text(rng.randrange(200)) + passage + text(50), text(rng.randrange(200)) + passage + text(9)))
    both = spark.createDataFrame(rows, "a string, b string").select(winnow.winnow(F.col("a")).alias("a"), winnow.winnow(F.col("b")).alias("b"))
    shared = both.select(F.size(F.array_intersect(winnow.hash_set(F.col("a")), winnow.hash_set(F.col("b")))).alias("n"))
    assert all(r.n >= 1 for r in shared.collect())


def test_slice_of(spark):
    cuts = [-5, 0, 3, 4, 9, 20, 21]
    rows = spark.range(-10, 30).select("id", winnow.slice_of(F.col("id"), cuts).alias("s")).collect()
    assert all(r.s == sum(c <= r.id for c in cuts) for r in rows)


def test_plan_is_native(spark):
    df = QUERIES["op5_fingerprints"](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "SinglePartition"))
