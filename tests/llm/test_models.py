import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import pseudo_lm, toxicity
from tidemark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def part(i):
    return zlib.crc32(str(i).encode()) % 4


def corpus(n=700, seed=3):
    rng = random.Random(seed)
    syllables = ["ba", "ko", "ri", "tes", "mun", "la", "fo", "den", "shi", "pra"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        ws, bad = [word() for _ in range(rng.randint(20, 200))], int(rng.random() < 0.25)
        for _ in range(bad * rng.randint(3, 6)):
            ws[rng.randrange(len(ws))] = rng.choice(["vilething", "grimgrub", "zzhorrid"])
        docs.append((i, " ".join(ws), "hot", 1))
        labels.append((i, 1, bad))
    return docs, labels


@pytest.fixture(scope="module")
def made(stored):
    docs, labels = corpus()
    return stored(docs, "doc_id long, text string, source string, score int"), stored(labels, "doc_id long, quality int, toxic int"), dict((i, t) for i, _, t in labels)


def test_toxicity_on_held_out_rows(made):
    docs, labels, toxic = made
    rows = toxicity.score_toxicity(docs, labels).collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (part(r.doc_id) == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out]
    right = sum(r.predicted == toxic[r.doc_id] for r in held)
    assert right >= 0.97 * len(held)
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, labels).collect()}
    assert kept == {r.doc_id for r in rows if not r.predicted}
    assert toxicity.drop_toxic(docs, labels).columns == docs.columns


def test_held_out_labels_change_nothing(made, spark):
    from pyspark.sql import functions as F

    docs, labels, _ = made
    turned = labels.withColumn("toxic", F.when(toxicity.part_of(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a = sorted(tuple(r) for r in toxicity.score_toxicity(docs, labels).collect())
    assert a == sorted(tuple(r) for r in toxicity.score_toxicity(docs, turned).collect())


def test_toxicity_of_odd_documents(odd_documents, no_documents, made, stored):
    docs, labels, _ = made
    none = stored([], "doc_id long, quality int, toxic int")
    odd = stored([(None, 1, 1), (3, 1, None), (4, 0, 1), (4, 0, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    for known in (none, odd, labels):
        rows = toxicity.score_toxicity(odd_documents, known).collect()
        assert len(rows) == odd_documents.count() and all(0 <= r.score <= 1 for r in rows)
        assert not any(r.held_out for r in rows if r.doc_id is None)
    assert toxicity.score_toxicity(no_documents, labels).collect() == []
    assert toxicity.drop_toxic(no_documents, none).collect() == []


def test_query_on_held_out_rows(spark):
    rows = QUERIES["op3_toxicity"](spark, FOLDER).collect()
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    held = [r for r in rows if r.held_out and r.doc_id in toxic]
    high = [r.score for r in held if toxic[r.doc_id]]
    low = [r.score for r in held if not toxic[r.doc_id]]
    auc = np.mean([[(a > b) + 0.5 * (a == b) for b in low] for a in high])
    # some documents are labelled toxic that hold nothing toxic
    assert auc >= 0.7 and np.mean([s >= 0.3 for s in low]) <= 0.02


def test_telling_runs_cover_the_marked_words():
    toxic, ordinary = ["a vilething b"] * 40, ["a ordinary b"] * 40
    pieces = toxicity.telling_pieces([f"{t} {i}" for i, t in enumerate(toxic)], [f"{t} {i}" for i, t in enumerate(ordinary)])
    assert set(toxicity.telling_runs(toxic, pieces)) == {b" vilething "}


def test_window_offsets_and_sides():
    texts = pa.array(["a b c", None, "", "d"])
    sides, tokens, offsets = pseudo_lm.token_windows(texts)
    assert offsets.tolist() == [0, 3, 3, 3, 4] and len(tokens) == 4
    a, b, c, d = tokens.tolist()
    begin, end = pseudo_lm.TOKENS, pseudo_lm.TOKENS + 1
    assert sides.T.tolist() == [[begin, begin, b, c], [begin, a, c, end], [a, b, end, end], [begin, begin, end, end]]


def test_network_probabilities_sum_to_one():
    counts = np.random.default_rng(1).integers(0, 50, pseudo_lm.TOKENS)
    network = pseudo_lm.Network(counts)
    sides = np.array([[1], [2], [3], [4]], np.uint16)
    every = np.arange(pseudo_lm.TOKENS)
    logs = network.log_probs(np.repeat(sides, len(every), 1), every)
    assert np.exp(logs.astype(np.float64)).sum() == pytest.approx(1.0, abs=1e-3)
    rows = network.parameters()
    network.load(rows + 1)
    assert np.allclose(network.parameters(), rows + 1)


def test_pseudo_likelihood_prefers_text_in_order(stored):
    rng = random.Random(4)
    follow = {f"w{i}": [f"w{rng.randrange(60)}" for _ in range(2)] for i in range(60)}
    docs = []
    for i in range(400):
        w = f"w{rng.randrange(60)}"
        ws = [w := rng.choice(follow[w]) for _ in range(120)]
        if i >= 360:  # the same words out of order
            rng.shuffle(ws)
        docs.append((i, " ".join(ws)))
    rows = stored(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in pseudo_lm.score_documents(rows, pseudo_lm.train_network(rows, epochs=8)).collect()}
    assert all(r.n_tokens == 120 and r.mean_log_prob == pytest.approx(r.log_prob / 120) for r in got.values())
    ordered, mixed = [got[i].mean_log_prob for i in range(360)], [got[i].mean_log_prob for i in range(360, 400)]
    assert np.mean(ordered) > np.mean(mixed) + 0.2


def test_scores_match_one_text_at_a_time(stored):
    docs, _ = corpus(40)
    rows = stored([d[:2] for d in docs], "doc_id long, text string")
    network = pseudo_lm.train_network(rows)
    got = {r.doc_id: r.log_prob for r in pseudo_lm.score_documents(rows, network).collect()}
    for i, text, *_ in docs:
        sides, tokens, _ = pseudo_lm.token_windows(pa.array([text]))
        assert got[i] == pytest.approx(float(network.log_probs(sides, tokens).sum()), rel=1e-4)


def test_scores_of_odd_documents(odd_documents, no_documents):
    rows = pseudo_lm.score_documents(odd_documents).collect()
    assert len(rows) == odd_documents.count()
    blank = [r for r in rows if r.n_tokens == 0]
    assert len(blank) == 3 and all(r.log_prob == 0 and r.mean_log_prob is None for r in blank)
    assert all(r.log_prob < 0 for r in rows if r.n_tokens)
    assert pseudo_lm.score_documents(no_documents).collect() == []


def test_rare_words_do_not_score_as_the_common_word_of_their_token(stored):
    import xxhash

    token = lambda w: xxhash.xxh3_64_intdigest(w.encode()) % pseudo_lm.TOKENS
    rare = next(w for w in (f"junk{i}" for i in range(10**6)) if token(w) == token("the"))
    texts = [*["a the b"] * 300, *["a the b " * 40] * 3, f"a {rare} b", "a the b", None]
    rows = stored(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.log_prob for r in pseudo_lm.score_documents(rows).collect()}
    assert got[304] - got[303] == pytest.approx(np.log(421), rel=1e-4) and got[305] == 0


def test_scores_by_whole_words_and_the_ways_to_join_them(stored, monkeypatch):
    from collections import Counter

    docs, _ = corpus(60)
    rows = stored([d[:2] for d in docs], "doc_id long, text string")
    counts = pseudo_lm.word_counts(rows)
    times = Counter(w for d in docs for w in d[1].split())
    assert sorted(r.n for r in counts.collect()) == sorted(times.values())
    network = pseudo_lm.train_network(rows, counts=counts)
    totals = Counter()
    for w, n in times.items():
        totals[pseudo_lm.token_windows(pa.array([w]))[1][0]] += n
    for common in (1, 1 << 8, 1 << 18):
        monkeypatch.setattr(pseudo_lm, "COMMON", common)
        got = {r.doc_id: r.log_prob for r in pseudo_lm.score_documents(rows, network, counts=counts).collect()}
        for i, text, *_ in docs:
            sides, tokens, _ = pseudo_lm.token_windows(pa.array([text]))
            share = sum(np.log(times[w] / (totals[t] + 0.5)) for w, t in zip(text.split(), tokens, strict=True))
            assert got[i] == pytest.approx(float(network.log_probs(sides, tokens).sum()) + share, rel=1e-4)


def test_tokens_and_classes_grow_with_the_vocabulary(spark):
    few, many = (pseudo_lm.Network(pseudo_lm.token_counts(spark.range(n).selectExpr("id as word", "1L as n"))) for n in (1000, 4_000_000))
    assert (few.size, few.classes) == (pseudo_lm.TOKENS, 64) and many.size == 12_000 and many.classes > 64
    assert many.parameters().shape[1] == pseudo_lm.HIDDEN


def test_toxicity_learns_from_and_scores_whole_long_texts(stored):
    docs, labels = corpus(300)
    filler = " ".join(t for _, t, *_ in corpus(400, 8)[0] if not any(w in t for w in ("vile", "grim", "zz")))
    # the telling passage stands far behind the first 20,000 characters, in the labelled texts as well
    docs = [(i, (filler[:25_000] + " " + t), s, n) for i, t, s, n in docs]
    clean, toxic = [" ".join([filler] * 3)[:300_000 + i] for i in range(2)], []
    toxic = [t + " vilething grimgrub zzhorrid" * 3 for t in clean]
    long = [(10_000 + i, t, "hot", 1) for i, t in enumerate(clean + toxic)]
    rows, known = stored(docs + long, "doc_id long, text string, source string, score int"), stored(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(rows, known).collect()}
    held = [(got[i].predicted, t) for i, _, t in labels if got[i].held_out]
    assert sum(p == t for p, t in held) >= 0.95 * len(held)
    assert [got[10_000 + i].predicted for i in range(4)] == [0, 0, 1, 1]
