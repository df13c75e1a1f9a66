import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from tidemark.llm import merkle, url_filter, variants
from tidemark.llm.queries import QUERIES, URL_RULES
from tidemark.llm.url_labels import ALLOWED_HOSTS, BLOCKED_HOSTS, labelled_urls

FOLDER = "/root/testdata/sf0.001"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


# --- URL filter


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if c in UPPER else c for c in host), path


def plain_rule(host, path, rules):
    fits = [(len(h + p), len(h), a == "block", a, h + p) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[3:] if fits else (None, None)


ODD_URLS = [
    None, "", "no scheme", "://", "x://", "http://A.Com", "http://A.Com/", "HTTP://WWW.EXAMPLE.COM/en/1", "http://example.com/en/x?y#z",
    "http://notexample.com/en/1", "a://b://c.net/es/", "http://ÄÖ.net/fr/é", "http://x.net?/es/", "http://net/es/", "http://.net/es/",
    "http://x.net./es/", "http://u@x.net:80/es/", "http://line\nbreak.com/a\nb", "http://" + "a" * 700_000 + ".org/" + "é🙂" * 300_000,
    "http://www.example.com/en", "http://www.example.com/EN/",
]


@pytest.fixture(scope="module")
def urls(stored):
    rows = [(i, u, "x", "r", "p", "s", "v") for i, u in enumerate(ODD_URLS)] + [(None, "http://x.net/es/1", None, None, None, None, None)] * 2
    return stored(rows, "page_id long, url string, html string, rule string, path string, score string, host string")


@pytest.mark.parametrize("in_tasks", [100, 2])
def test_rules_fit_the_longest(spark, urls, in_tasks):
    more = [("allow", "b.net", "/x"), ("block", "B.NET", "/x"), ("allow", None, "/"), ("block", "line\nbreak.com", "/a")]
    rules = spark.createDataFrame(URL_RULES + more, "action string, host string, path string")
    got = url_filter.judge_urls(urls, rules, labelled_urls(spark), rules_in_tasks=in_tasks).collect()
    clean = [(a, h.lower(), p) for a, h, p in URL_RULES + more if h]
    want = []
    for r in urls.collect():
        host, path = plain_parts(r.url)
        action, rule = plain_rule(host, path, clean)
        want.append((r.page_id, host, path, rule, action))
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == Counter(x[:4] for x in want)
    decided = {x[:4]: x[4] for x in want if x[4]}
    for r in got:
        learned = "block" if r.score >= url_filter.THRESHOLD else "allow"
        assert r.verdict == decided.get((r.page_id, r.host, r.path, r.rule), learned) and 0 <= r.score <= 1


def test_grams_do_not_depend_on_stretches(monkeypatch):
    texts = ["", "a", "ab", "a.b.c", "x" * 50, "é🙂" * 20]

    def found():
        out = Counter()
        for rows, at in url_filter.grams(texts, 1):
            out.update(zip(rows.tolist(), at.tolist(), strict=True))
        return out

    whole = found()
    monkeypatch.setattr(url_filter, "STRETCH", 7)
    assert found() == whole
    # every window of two to five characters, marks at the ends included
    for i, t in enumerate(texts):
        assert sum(n for (row, _), n in whole.items() if row == i) == sum(max(0, len(t) + 2 - n + 1) for n in url_filter.GRAMS)


def test_model_on_hosts_it_has_not_seen(spark):
    rows = [(plain_parts(r.url), r.blocked) for r in labelled_urls(spark).collect()]
    stems = sorted({(re.sub(r"^(www|blog|m)\.", "", h), y) for (h, _), y in rows})
    random.Random(3).shuffle(stems)
    right = Counter()
    for fold in range(5):
        held = {s for s, _ in stems[fold::5]}
        of = [re.sub(r"^(www|blog|m)\.", "", h) in held for (h, _), _ in rows]
        fit = [r for r, o in zip(rows, of, strict=True) if not o]
        model = url_filter.UrlModel().fit([h for (h, _), _ in fit], [p for (_, p), _ in fit], np.array([float(y) for _, y in fit]))
        test = [r for r, o in zip(rows, of, strict=True) if o]
        scores = model.score([h for (h, _), _ in test], [p for (_, p), _ in test])
        for (_, y), s in zip(test, scores, strict=True):
            right[y, bool((s >= 0.5) == bool(y))] += 1
    assert right[0, True] / (right[0, True] + right[0, False]) > 0.8
    assert right[1, True] / (right[1, True] + right[1, False]) > 0.6
    assert len(BLOCKED_HOSTS) + len(ALLOWED_HOSTS) < 200


def test_regression_against_plain_newton():
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "kappa"]
    hosts = [".".join(rng.sample(words, 2)) for _ in range(60)]
    y = np.array([float("alpha" in h or ("beta" in h and i % 3 == 0)) for i, h in enumerate(hosts)])
    model = url_filter.UrlModel().fit(hosts, [""] * 60, y)
    # the gradient of the regularised loss vanishes
    found = [g for seed, texts in enumerate((hosts, [""] * 60), 1) for g in url_filter.grams(texts, seed)]
    cells = {(r, a) for rows, at in found for r, a in zip(rows.tolist(), at.tolist(), strict=True)}
    used = sorted({a for _, a in cells})
    x = np.zeros((60, len(used)))
    for r, a in cells:
        x[r, used.index(a)] = 1
    w = model.weights[used]
    weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (60 - y.sum()))
    miss = weight * (1 / (1 + np.exp(-(x @ w + model.constant))) - y)
    assert np.abs(x.T @ miss + url_filter.RIDGE / 60 * w).max() < 2e-3 and abs(miss.sum()) < 2e-3


def test_labels_of_one_kind_and_empty_table(spark, stored):
    rules = spark.createDataFrame([], "action string, host string, path string")
    one = spark.createDataFrame([("http://a.com/", 0), (None, None)], "url string, blocked int")
    pages = stored([(1, "http://spam.example.net/"), (2, None)], "page_id long, url string")
    got = url_filter.judge_urls(pages, rules, one).collect()
    assert {(r.verdict, r.rule) for r in got} == {("allow", None)} and len({r.score for r in got}) == 1
    assert url_filter.judge_urls(stored([], "page_id long, url string"), rules, one).collect() == []


def test_url_query(spark):
    pages = spark.read.parquet(f"{FOLDER}/pages.parquet").collect()
    got = {r.page_id: r for r in QUERIES["op11_url_filter"](spark, FOLDER).collect()}
    assert len(got) == len(pages)
    for p in pages:
        host, path = plain_parts(p.url)
        action, rule = plain_rule(host, path, URL_RULES)
        r = got[p.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and (action is None or r.verdict == action)


# --- spelling variants


def plain_words(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c in UPPER else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def plain_variants(rows):
    counts = plain_words(rows)
    words = sorted(counts)
    near = defaultdict(list)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda x: (-counts[x], x))
            if counts[best] >= 5 * counts[w]:
                form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return out


def spread(seed=4):
    """Texts of words with mistakes, few letters (so that pivots are frequent), chains and letters beyond ASCII."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abc") for _ in range(rng.randint(5, 9))) for _ in range(120)]
    base += ["straße", "straßen", "CAFÉTÉRIA", "cafétéria", "Ünïcode", "aaaaaaa", "aaaaaaaa", "abababab", "babababa", "naïveté×÷"]
    texts = []
    for i in range(250):
        words = []
        for _ in range(60):
            w = base[min(int(rng.expovariate(0.05)), len(base) - 1)]
            if rng.random() < 0.15:
                k, c = rng.randrange(len(w)), rng.choice("abcé")
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:]])
            words.append(w)
        texts.append((i, rng.choice([" ", "-", "1", "\n"]).join(words)))
    chain = ["chainword"] * 700 + ["chainwort"] * 130 + ["chainwart"] * 25 + ["chinwart"] * 5
    return texts + [(900, " ".join(chain)), (901, None), (902, ""), (None, "abababab " * 9), (None, "abababab " * 9)]


def test_variants_against_every_pair(stored):
    rows = spread()
    got = variants.group_variants(stored([(i, t, "w", 1, "k") for i, t in rows], "doc_id long, text string, word string, n int, key string")).collect()
    want = plain_variants(rows)
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert {"chainwort", "chainwart", "chinwart"} <= {r.word for r in got if r.root == "chainword"}
    assert sum(r.n_near for r in got) > 100


def test_each_pair_is_found_once(spark, stored):
    words = stored([(w, n) for w, n in plain_words(spread()).items()], "word string, n long")
    pairs = [(r.a, r.b) for r in variants.near_pairs(words, variants.gram_ranks(words)).collect()]
    assert len({frozenset(p) for p in pairs}) == len(pairs)


def test_pivots_are_the_rarest_disjoint_grams():
    rng = random.Random(9)
    for _ in range(500):
        ranks = [rng.randrange(12) for _ in range(rng.randint(3, 9))]
        spots = list(enumerate(ranks))
        a, b = variants.pick_pivots(spots)
        best = min(ranks[i] + ranks[j] for i in range(len(ranks)) for j in range(i + 2, len(ranks)))
        assert b - a >= 2 and ranks[a] + ranks[b] == best


def test_words_of_an_empty_table(stored, odd_documents, no_documents):
    assert variants.group_variants(no_documents).collect() == []
    rows = [(r.doc_id, r.text) for r in odd_documents.select("doc_id", "text").collect()]
    got = variants.group_variants(odd_documents).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_variants(rows))


def test_variant_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    got = QUERIES["op12_spelling_variants"](spark, FOLDER).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain_variants(rows))


# --- Merkle manifest


def hex_of(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(values):
    return hex_of(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def plain_tree(nodes):
    """Levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([hex_of(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_path(levels, at):
    """(siblings before, siblings after) a leaf, level by level."""
    out = []
    for level in levels[:-1]:
        first = at // 16 * 16
        out.append((level[first:at], level[at + 1 : first + 16]))
        at //= 16
    return out


def plain_manifest(rows):
    sources = defaultdict(list)
    for r in rows:
        sources[r.source].append((r.doc_id is not None, r.doc_id or 0, plain_leaf((r.doc_id, r.source, r.lang, r.n_chars, r.text)), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    top = plain_tree([trees[s][-1][0] for s in order])
    out = []
    for pos, s in enumerate(order):
        for at, (_, _, leaf, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            path = plain_path(trees[s], at) + plain_path(top, pos)
            proof = hex_of(*[h for before, after in path for h in before + after])
            node = leaf
            if zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0 and r.text is not None:
                text = "".join(c.lower() if c in UPPER else c for c in r.text)
                node = plain_leaf((r.doc_id, r.source, r.lang, r.n_chars, text))
            for before, after in path:
                node = hex_of(*before, node, *after)
            out.append((r.doc_id, leaf, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0], s, at))
    return out


SHAPE = "doc_id long, text string, lang string, source string, n_chars long, leaf string, place int, src string, block int, size string"


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_against_plain_trees(stored, monkeypatch, levels):
    # smaller blocks, so that trees pass beyond them
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 16**levels)
    rng = random.Random(levels)
    rows = [(i, f"Text {i}" if i % 7 else "lower", "en", "hot", i, "l", 1, "s", 1, "z") for i in rng.sample(range(10_000), 700)]
    rows += [(i, f"T{i}", None, f"s{i % 30}", None, None, None, None, None, None) for i in range(90)]
    rows += [(i, "é🙂", "en", x, 3, "l", 1, "s", 1, "z") for i, x in enumerate([None, "", "é", "Z", "\U0001f642", "a"])]
    rows += [(None, "N", "en", "hot", 1, "l", 1, "s", 1, "z"), (None, None, None, "hot", 1, "l", 1, "s", 1, "z"), (None, "N", None, None, 1, "l", 1, "s", 1, "z")]
    rows += [(-5, "Twice", "en", "hot", 1, "l", 1, "s", 1, "z")] * 3 + [(-5, "other", "en", "hot", 1, "l", 1, "s", 1, "z")]
    docs = stored(rows, SHAPE)
    got = merkle.prove_rows(docs).collect()
    assert Counter(tuple(r) for r in got) == Counter(plain_manifest(docs.collect()))
    assert 0 < sum(not r.verified for r in got) < len(got) / 3


@pytest.mark.parametrize("size", [1, 2, 16, 17, 257])
def test_one_source(stored, size):
    docs = stored([(i, f"D{i}", "en", "s", 1, "l", 1, "s", 1, "z") for i in range(size)], SHAPE)
    assert Counter(tuple(r) for r in merkle.prove_rows(docs).collect()) == Counter(plain_manifest(docs.collect()))


def test_odd_and_no_documents(odd_documents, no_documents):
    assert Counter(tuple(r) for r in merkle.prove_rows(odd_documents).collect()) == Counter(plain_manifest(odd_documents.collect()))
    assert merkle.prove_rows(no_documents).collect() == []


def test_missing_nodes_are_the_least():
    rng = random.Random(1)
    for _ in range(200):
        count = rng.randint(1, 900)
        known = rng.sample(range(count), rng.randint(1, min(count, 40)))
        need, held, level, c = [], set(known), 0, count
        while c > 1:
            ups = {i // 16 for i in held}
            need += [(level, i) for i in range(c) if i // 16 in ups and i not in held]
            held, c, level = ups, -(-c // 16), level + 1
        assert merkle.missing(known, count) == need
        levels = plain_tree([hex_of(str(i)) for i in range(count)])
        paths = merkle.Paths({i: levels[0][i].encode() for i in known}, count, {(x, i): levels[x][i].encode() for x, i in need})
        assert paths.root.decode() == levels[-1][0]
        for i in known:
            assert paths.siblings(0, i).decode() == "".join(h for a, b in plain_path(levels, i) for h in a + b)
            assert paths.fold(0, i, levels[0][i].encode()).decode() == levels[-1][0]


def test_manifest_query(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    assert Counter(tuple(r) for r in QUERIES["op13_merkle_manifest"](spark, FOLDER).collect()) == Counter(plain_manifest(rows))
