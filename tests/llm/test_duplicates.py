import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa

from tidemark.llm import graph, jaccard, recipes, repeats
from tidemark.llm.queries import QUERIES
from tidemark.session import cut_lineage

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts_with_copies(seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(60):
        docs.append([rng.choice(words) for _ in range(rng.randint(1, 160))])
    shared = [rng.choice(words) for _ in range(50)]
    for _ in range(60):
        kind, base = rng.random(), list(rng.choice(docs))
        if kind < 0.25:
            docs.append(base)
        elif kind < 0.6:
            for _ in range(rng.randint(1, 4)):
                base[rng.randrange(len(base))] = rng.choice(words)
            docs.append(base)
        else:
            cut = rng.randrange(len(base) + 1)
            docs.append(base[:cut] + shared + base[cut:])
    # many near copies of one text, and chunks of a long one that move
    hot = [rng.choice(words) for _ in range(120)]
    for i in range(40):
        docs.append(hot[: 60 + i % 3] + [f"n{i}"] + hot[60 + i % 3 :])
    long = [rng.choice(words) for _ in range(3000)]
    docs += [long, long, ["x", *long], [*long[:1500], "y", *long[1500:]]]
    return [" ".join(d) for d in docs] + [None, "", "  ", "w1 w2", "w1  w2"]


def brute_exact(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    return groups


def test_exact_groups(stored):
    docs = stored(list(enumerate(texts_with_copies())), "doc_id long, text string")
    groups = brute_exact(docs.collect())
    want = {}
    for text, ids in groups.items():
        for i in ids:
            want[i] = (max(ids), len(ids), i == max(ids), hashlib.sha256(text.encode()).hexdigest())
    for digest_bytes in (16, 1):  # one byte makes different chunks share a digest
        got = recipes.exact_groups(docs, digest_bytes=digest_bytes).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want
        assert len(got) == len(want)
    kept = recipes.drop_copies(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted(max(ids) for ids in groups.values())


def test_exact_groups_of_odd_documents(odd_documents, no_documents):
    got = recipes.exact_groups(odd_documents).collect()
    groups = brute_exact(odd_documents.collect())
    assert len(got) == odd_documents.count()
    by_sha = defaultdict(list)
    for r in got:
        by_sha[r.text_sha256].append(r)
    for text, ids in groups.items():
        rows = by_sha[hashlib.sha256(text.encode()).hexdigest()]
        known = [i for i in ids if i is not None]
        assert {r.keep_id for r in rows} == {max(known) if known else None}
        assert sum(r.kept for r in rows) == 1 and {r.group_size for r in rows} == {len(ids)}
    assert recipes.drop_copies(odd_documents).columns == odd_documents.columns
    assert recipes.exact_groups(no_documents).collect() == []
    assert recipes.drop_copies(no_documents).collect() == []


def test_cut_points_are_content_defined():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 256, 200_000).astype(np.uint8)
    ends = recipes.cut_points(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes[:-1].min() >= recipes.LEAST and sizes.max() <= recipes.MOST
    chunks = {bytes(data[a:b]) for a, b in zip([0, *ends], ends, strict=False)}
    moved = np.concatenate([data[:70_000], rng.integers(0, 256, 11).astype(np.uint8), data[70_000:]])
    ends = recipes.cut_points(moved)
    again = {bytes(moved[a:b]) for a, b in zip([0, *ends], ends, strict=False)}
    assert len(chunks & again) >= len(chunks) - 4
    assert recipes.cut_points(data[:0]) == [] and recipes.cut_points(np.zeros(40_000, np.uint8))[-1] == 40_000


def brute_links(texts, n=5, similarity=0.8):
    sets = []
    for t in texts:
        ws = (t or "").split()
        sets.append(frozenset(tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))) if ws else frozenset())
    kinds = sorted(set(sets), key=lambda s: sets.index(s))
    links = defaultdict(set)
    for a in range(len(kinds)):
        for b in range(a):
            if kinds[a] and kinds[b] and len(kinds[a] & kinds[b]) >= similarity * len(kinds[a] | kinds[b]):
                links[a].add(b)
                links[b].add(a)
    label = {}
    for start in range(len(kinds)):
        todo = [start]
        while todo:
            k = todo.pop()
            if k not in label:
                label[k] = start
                todo += links[k]
    return [(kinds.index(s), len(links[kinds.index(s)]), label[kinds.index(s)]) for s in sets]


def test_near_duplicates_are_all_links(stored):
    texts = texts_with_copies(4)
    docs = stored(list(enumerate(texts)), "doc_id long, text string")
    want = brute_links(texts)
    first = defaultdict(list)
    for i, (kind, _, label) in enumerate(want):
        first["set", kind].append(i)
        first["class", label].append(i)
    expected = {i: (min(first["class", lab]), links, min(first["set", kind]), len(first["set", kind])) for i, (kind, links, lab) in enumerate(want)}
    for block in (256, 7):  # seven texts a block: a large group is verified in many blocks
        got = jaccard.near_duplicates(docs, block=block).collect()
        assert {r.doc_id: (r.class_id, r.n_links, r.set_id, r.copies) for r in got} == expected
    kept = jaccard.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for c, *_ in expected.values()})


def boilerplate(count, seed=12):
    """Texts of 120 words, half of them the same in all: near nobody, but often in one band with others."""
    rng = random.Random(seed)
    same = [f"s{i}" for i in range(60)]
    return [" ".join(same + [f"u{rng.randrange(10**9)}" for _ in range(60)]) for _ in range(count)]


def test_texts_that_share_a_half_are_verified_by_bucket(stored):
    for count in (1000, 3000):
        docs = stored(list(enumerate(boilerplate(count))), "doc_id long, text string")
        bands, rows = jaccard.bands_and_rows(0.8, jaccard.RECALL, jaccard.MOST_HASHES)
        signed = jaccard._signatures(docs.selectExpr("doc_id as row", "doc_id", "text"), 5, bands, rows)
        signed = cut_lineage(signed)
        seats = jaccard.seats_of(signed, signed.select("row"), 16).collect()
        members = defaultdict(set)
        blocks = 0
        for r in seats:
            for seat in r.seats:
                members[seat.band, seat.group].add(r.row)
                blocks += seat.blocks
        # pairs of a common band sit in one group: in its first band, or together
        by_row = {r.row: r for r in seats}
        met = defaultdict(set)
        for r in signed.collect():
            for band, value in enumerate(r.bands):
                met[band, value].add(r.row)
        together = {seat.group: members[-1, seat.group] for r in seats for seat in r.seats if seat.band < 0}
        for (band, value), bucket in met.items():
            if len(bucket) < 2:
                continue
            for a, b in zip(sorted(bucket), sorted(bucket)[1:], strict=False):
                first = min(i for i in range(bands) if by_row[a].bands[i] == by_row[b].bands[i])
                value = by_row[a].bands[first]
                assert {a, b} <= members[first, value] or any({a, b} <= t for t in together.values())
        root = graph.components(docs.sparkSession.createDataFrame(
            [(min(b), x) for b in met.values() if len(b) > 1 for x in b if x != min(b)], "u long, v long"
        )).groupBy("label").count().collect()
        whole = sum(r["count"] * -(-r["count"] // 16) for r in root)
        assert blocks < whole / 3
        got = jaccard.near_duplicates(docs, block=16).collect()
        assert len(got) == count and all(r.n_links == 0 and r.class_id == r.doc_id for r in got)


def test_ways_of_verifying_agree(stored, monkeypatch):
    """Variants of one text among boilerplate, verified as a whole set, by bucket, and in blocks cut by length."""
    rng = random.Random(3)
    base = boilerplate(1, 5)[0].split()
    texts = boilerplate(120)
    for _ in range(60):
        words = list(base)
        for _ in range(rng.randint(1, 3)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(50)}"
        texts.append(" ".join(words))
    docs = stored(list(enumerate(texts)), "doc_id long, text string")
    want = [(w[0], w[1]) for w in brute_links(texts)]
    results = []
    for block, unit in ((256, 2048), (16, 2048), (16, 40), (3, 2048)):
        monkeypatch.setattr(jaccard, "UNIT", unit)
        got = sorted(map(tuple, jaccard.near_duplicates(docs, block=block).drop("row", "root").collect()))
        results.append(got)
    assert results.count(results[0]) == len(results)
    # a pair just at the similarity may share no band
    links = {r[0]: r[2] for r in results[0]}
    assert sum(abs(links[i] - w[1]) for i, w in enumerate(want)) <= 0.005 * sum(w[1] for w in want)


def test_first_shared_band():
    rng = np.random.default_rng(8)
    left, right = rng.integers(0, 4, (9, 6)), rng.integers(0, 4, (7, 6))
    got = jaccard.first_shared(left, right)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            assert got[i, j] == next((k for k in range(6) if a[k] == b[k]), 6)


def test_near_duplicates_of_odd_documents(odd_documents, no_documents):
    got = jaccard.near_duplicates(odd_documents).collect()
    assert len(got) == odd_documents.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].class_id == by[1].class_id == by[2].class_id == 0 and by[0].n_links == 0 and by[0].copies == 3
    assert by[40].class_id == 3 and by[40].copies == 4
    assert len(jaccard.keep_one(odd_documents).collect()) == len({r.root for r in got})
    assert jaccard.keep_one(odd_documents).columns == odd_documents.columns
    assert jaccard.near_duplicates(no_documents).collect() == [] and jaccard.keep_one(no_documents).collect() == []


def test_bands_meet_the_recall():
    for similarity in (0.5, 0.8, 0.9):
        bands, rows = jaccard.bands_and_rows(similarity, 0.999, 400)
        assert bands * rows <= 400 and 1 - (1 - similarity**rows) ** bands >= 0.999


def test_links_within_matches_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30, rng.integers(1, 20))).astype(np.uint64) for _ in range(40)]
    for left, right in ((sets, None), (sets[:15], sets[15:])):
        got = jaccard.links_within(left, right, 0.5)
        for i, a in enumerate(left):
            for j, b in enumerate(right or left):
                same = len(np.intersect1d(a, b)) >= 0.5 * len(np.union1d(a, b)) and not (right is None and i == j)
                assert got[i, j] == same


def test_components(spark):
    rng = random.Random(6)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(root)}
    got = graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert {r.node: r.label for r in got} == want and len(got) == len(want)
    assert graph.components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_keep_the_size_estimate_small(spark, capsys):
    """A long path takes many rounds; the estimate of their plans must not grow with each, as all its digits are kept."""
    graph.components(spark.range(300).selectExpr("id AS u", "id + 1 AS v")).explain("cost")
    said = capsys.readouterr().out
    powers = [int(x) for x in re.findall(r"E\+(\d+) B", said)]
    assert "sizeInBytes" in said and max(powers, default=0) < 100


def brute_repeats(rows, length=35):
    words = [WORD.findall(r.text or "") for r in rows]
    seen = defaultdict(list)
    for d, ws in enumerate(words):
        for i in range(len(ws) - length + 1):
            seen[tuple(ws[i : i + length])].append((d, i))
    gone = defaultdict(set)
    for spots in seen.values():
        if len(spots) > 1:
            for d, i in spots:
                gone[d].update(range(i, i + length))
    return [
        (r.doc_id, len(ws), len(gone[d]), hashlib.sha256(" ".join(w for j, w in enumerate(ws) if j not in gone[d]).encode()).hexdigest())
        for d, (r, ws) in enumerate(zip(rows, words, strict=True))
    ]


def key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def test_repeats(stored):
    texts = texts_with_copies(8) + [" ".join(["a"] * 36), " ".join(["b"] * 35), " ".join(["c"] * 100), "\t".join(["a"] * 35)]
    docs = stored(list(enumerate(texts)), "doc_id long, text string")
    want = key(brute_repeats(docs.collect()))
    for seed in (10, 35, 1):
        got = key(tuple(r) for r in repeats.remove_repeats(docs, seed=seed).collect())
        assert got == want


def test_words_with_one_hash_are_told_apart(stored, monkeypatch):
    """Two words whose first hashes collide make two passages."""
    texts = [" ".join(["left"] + [f"w{i}" for i in range(34)]), " ".join(["right"] + [f"w{i}" for i in range(34)])]
    got = {}
    for extra in ([], texts[:1]):
        batch = pa.RecordBatch.from_arrays(
            [pa.array(range(len(texts + extra))), pa.array(texts + extra), pa.array([[0]] * len(texts + extra), pa.list_(pa.int64())), pa.array([True] * len(texts + extra))],
            ["row", "text", "anchors", "single"],
        )
        hashes = repeats.word_hashes

        def colliding(words, seed=0, hashes=hashes):
            out = hashes(words, seed)
            same = [w.as_py() in ("left", "right") for w in words]
            return np.where(same, np.uint64(9), out) if not seed else out

        monkeypatch.setattr(repeats, "word_hashes", colliding)
        monkeypatch.setattr(repeats.np, "isin", lambda a, b: np.ones(len(a), bool))
        rows = pa.Table.from_batches(repeats._extend(35, 8)(iter([batch]))).to_pylist()
        monkeypatch.undo()
        got[len(extra)] = [(r["h"], r["check"]) for r in rows]
    assert len({h for h, _ in got[1]}) == 1 and len(set(got[0])) == 2 and len(set(got[1])) == 2 and len(got[1]) == 3


def test_repeats_of_odd_documents(odd_documents, no_documents):
    got = key(tuple(r) for r in repeats.remove_repeats(odd_documents).collect())
    assert got == key(brute_repeats(odd_documents.collect()))
    assert repeats.remove_repeats(no_documents).collect() == []


def test_rightmost_minima():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 5, 300).astype(np.uint64)
    for width in (1, 2, 3, 26, 32):
        got = repeats.rightmost_minima(values, width)
        want = [max(j for j in range(i, i + width) if values[j] == values[i : i + width].min()) for i in range(300 - width + 1)]
        assert got.tolist() == want
    assert len(repeats.rightmost_minima(values[:3], 4)) == 0


def test_queries_match_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").orderBy("doc_id").collect()
    want = brute_links([r.text for r in rows])
    got = {r.doc_id: r for r in QUERIES["op7_ngram_jaccard"](spark, folder).collect()}
    assert [got[r.doc_id].n_links for r in rows] == [w[1] for w in want]
    label = {w[2]: rows[i].doc_id for i, w in reversed(list(enumerate(want)))}
    assert [got[r.doc_id].class_id for r in rows] == [label[w[2]] for w in want]


def test_files_split_anew_between_scans(spark, stored, monkeypatch):
    from tidemark.llm import mixing, warc

    texts = texts_with_copies()
    docs = stored([(i, t, f"s{i % 3}") for i, t in enumerate(texts)], "doc_id long, text string, source string", 12)
    pages = stored([(i, f"http://h/{i}", t) for i, t in enumerate(texts)], "page_id long, url string, html string", 12)
    steps = [
        lambda: recipes.drop_copies(docs),
        lambda: jaccard.near_duplicates(docs).drop("row", "root"),
        lambda: jaccard.keep_one(docs),
        lambda: repeats.remove_repeats(docs),
        lambda: mixing.take_mix(docs),
        lambda: warc.mark_revisits(pages),
    ]
    conf = {"spark.sql.files.minPartitionNum": "1", "spark.sql.files.openCostInBytes": "1"}

    def run(step):
        try:
            return sorted(map(str, step().collect()))
        finally:
            for key in conf:
                spark.conf.unset(key)

    want = [run(step) for step in steps]
    for module in (recipes, jaccard, repeats, mixing, warc):

        def then_split(df, cut=module.cut_lineage):
            out = cut(df)
            for key, value in conf.items():
                spark.conf.set(key, value)
            return out

        monkeypatch.setattr(module, "cut_lineage", then_split)
    assert [run(step) == w for step, w in zip(steps, want, strict=True)] == [True] * len(steps)
