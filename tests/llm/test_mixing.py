import random
import re
from collections import defaultdict

import pytest

from tidemark.llm import mixing
from tidemark.llm.queries import QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets_of(sizes):
    """Targets by source, as the plain rounds of resharing give them."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        share = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * share > 3 * sizes[s]}
        if not over:
            return {s: 3 * sizes[s] if s in capped else weight[s] * share for s in names}
        capped |= over


def check(docs, rows):
    words = {r.doc_id: len(WORD.findall(r.text or "")) for r in docs}
    sizes, source = defaultdict(int), {}
    for r in docs:
        sizes[r.source] += words[r.doc_id]
        source[r.doc_id] = r.source
    targets, taken = targets_of(dict(sizes)), defaultdict(int)
    for r in rows:
        assert r.size == words[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(targets[source[r.doc_id]])
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        taken[source[r.doc_id]] += r.taken
    assert len(rows) == len(docs)
    return targets, taken


def test_query_meets_targets(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = QUERIES["op8_source_mix"](spark, folder).collect()
    targets, taken = check(docs, rows)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 1
    again = QUERIES["op8_source_mix"](spark, folder).collect()
    assert sorted(again) == sorted(rows)


def test_uneven_sources_and_layouts(stored):
    rng = random.Random(2)
    docs = []
    for i in range(500):
        source = rng.choice(["hot"] * 12 + ["é", "z", "A", None, "\U0001f642", "￮"])
        docs.append((i, " ".join(["w"] * rng.choice([0, 1, 2, 3, 7, 50, 400])), source))
    schema = "doc_id long, text string, source string"
    one, other = stored(docs, schema, 1), stored(docs[::-1], schema, 5)
    rows = mixing.mix_sources(one).collect()
    targets, taken = check(one.collect(), rows)
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 400
    assert sorted(tuple(r)[:5] for r in mixing.mix_sources(other).collect()) == sorted(tuple(r)[:5] for r in rows)
    mixed = mixing.take_mix(other).collect()
    copies = defaultdict(int)
    for r in mixed:
        copies[r.doc_id] += 1
    assert {r.doc_id: r.copies for r in rows if r.copies} == dict(copies)


def test_odd_documents(odd_documents, no_documents):
    rows = mixing.mix_sources(odd_documents).collect()
    assert len(rows) == odd_documents.count() and all(0 <= r.copies <= 3 for r in rows)
    mixed = mixing.take_mix(odd_documents)
    assert mixed.columns == odd_documents.columns and mixed.count() == sum(r.copies for r in rows)
    assert mixing.mix_sources(no_documents).collect() == [] and mixing.take_mix(no_documents).collect() == []


def test_columns_named_as_the_operator_names_its_own(stored):
    names = ["_taken_row", "_taken_copies", "_taken_copy", "_TAKEN_ROW_", "_row_number", "copies", "_part", "a.b"]
    docs = stored([(i, "w " * (i + 1), "ab"[i % 2], *[i] * len(names)) for i in range(12)], ", ".join(["doc_id long, text string, source string", *[f"`{n}` int" for n in names]]))
    mixed = mixing.take_mix(docs)
    assert mixed.columns == docs.columns and all(set(r[3:]) == {r.doc_id} for r in mixed.collect())


def test_empty_texts_only(stored):
    docs = stored([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.target, r.taken) for r in mixing.mix_sources(docs).collect()) == [(1, 0.0, 0), (2, 0.0, 0)]


def test_fit_budget_is_the_best_sum():
    rng = random.Random(4)
    for _ in range(200):
        lengths = rng.sample(range(1, 30), rng.randint(1, 5))
        counts = [rng.randint(1, 4) for _ in lengths]
        whole = sum(a * b for a, b in zip(lengths, counts, strict=True))
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        budget = rng.randint(0, whole + 5)
        taken = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert sum(n * t for n, t in zip(lengths, taken, strict=True)) == max(s for s in sums if s <= budget)


def test_fit_budget_of_many_documents():
    rng = random.Random(5)
    lengths = sorted(rng.sample(range(1, 5000), 900))
    counts = [rng.randint(1, 10_000) for _ in lengths]
    whole = sum(a * b for a, b in zip(lengths, counts, strict=True))
    for part in (0.001, 0.3, 0.77, 0.9999):
        budget = int(whole * part)
        taken = mixing.fit_budget(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
        assert budget - sum(n * t for n, t in zip(lengths, taken, strict=True)) <= 1


def test_word_count(one):
    for text in ["", " a ", "a\tb\nc\x0bd\x0ce\rf", "\x1fa\x85b c", "日本 語", "  a  b  "]:
        assert one(mixing.word_count(__import__("pyspark").sql.functions.col("t")), t=text) == len(WORD.findall(text))


def test_fit_budget_of_very_long_documents(monkeypatch):
    assert mixing.fit_budget([100_000], [2], 120_000) == [1]
    assert mixing.fit_budget([70_000, 100_000], [1, 1], 120_000) == [0, 1]
    rng = random.Random(6)
    for _ in range(60):
        lengths = rng.sample(range(50_000, 900_000), rng.randint(1, 4))
        counts = [rng.randint(1, 2) for _ in lengths]
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + n * k for s in sums for k in range(c + 1)}
        # below twice the longest all is fitted; above, the greedy part goes first
        budget = rng.randint(0, max(lengths))
        taken = mixing.fit_budget(lengths, counts, budget)
        assert sum(n * t for n, t in zip(lengths, taken, strict=True)) == max(s for s in sums if s <= budget)
    # nothing that fits is left out where documents are longer than what is fitted at most
    monkeypatch.setattr(mixing, "MOST_FIT_WORDS", 1 << 16)
    assert mixing.fit_budget([100_000], [2], 120_000) == [1]
    for _ in range(60):
        lengths = rng.sample(range(50_000, 900_000), 4)
        counts = [rng.randint(1, 5) for _ in lengths]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts, strict=True)))
        taken = mixing.fit_budget(lengths, counts, budget)
        left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
        assert left >= 0 and all(n > left or t == c for n, t, c in zip(lengths, taken, counts, strict=True))
