"""URL filter: rules by host and path, and a logistic regression on hashed character n-grams for all other URLs."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, slices

#: Host behind the first ``://``, and path.
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Lengths of the character n-grams, and the bits of their hashes.
GRAMS, BITS = (2, 3, 4, 5), 18
#: Labelled URLs that are learned from, those with the least hashes, where there are more.
LABELLED_ROWS = 20_000
RIDGE, STEPS = 0.5, 400
THRESHOLD = 0.5
#: Rules that every task holds; more of them are joined.
RULES_IN_TASKS = 100_000
#: Codes at either end of a part; no character has them.
START, END = 0x110000, 0x110001
#: Characters whose n-grams are hashed at once.
STRETCH = 1 << 19

SCHEMA = "page_id long, host string, path string, rule string, verdict string, score double"
_KEEP = "page_id long, host string, path string, rule string, action string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://`` or for null."""
    text = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(text, PARTS, 1), UPPER, UPPER.lower())
    return host, F.regexp_extract(text, PARTS, 2)


def grams(texts: Sequence[str], seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashed character n-grams of texts, each with marks at its ends: (number of the text, place in the weights).

    They come in stretches, so a very long text needs no more memory than a stretch. ``seed`` keeps hosts and paths
    apart.
    """
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 2
    ends = np.cumsum(sizes)
    codes = np.empty(int(ends[-1]) if len(ends) else 0, np.uint32)
    marks = np.zeros(len(codes), bool)
    marks[ends - sizes] = marks[ends - 1] = True
    codes[~marks] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes[ends - sizes], codes[ends - 1] = START, END
    of = np.repeat(np.arange(len(texts)), sizes)
    for a in range(0, len(codes), STRETCH):
        part, owner = codes[a : a + STRETCH + max(GRAMS) - 1].astype(np.uint64), of[a : a + STRETCH + max(GRAMS) - 1]
        h = mix64(part + np.uint64(seed << 32))
        for n in range(2, max(GRAMS) + 1):
            if len(part) < n:
                break
            h = mix64(h[: len(part) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + part[n - 1 :])
            if n in GRAMS:
                # windows that begin in this stretch and end in their text
                m = min(len(h), STRETCH)
                whole = owner[:m] == owner[n - 1 : n - 1 + m]
                yield owner[:m][whole], (h[:m][whole] >> np.uint64(64 - BITS)).astype(np.int64)


def gram_cells(texts: Sequence[str], seed: int) -> np.ndarray:
    """The distinct n-grams of each text, as number of the text and place in the weights in one integer."""
    cells = np.zeros(0, np.int64)
    for rows, at in grams(texts, seed):
        cells = np.union1d(cells, (rows << BITS) + at)
    return cells


def groups(texts: Sequence[str]) -> Iterator[slice]:
    """Stretches of texts of about STRETCH characters; a longer text is alone."""
    start = held = 0
    for i, t in enumerate(texts):
        if i > start and held + len(t) > STRETCH:
            yield slice(start, i)
            start, held = i, 0
        held += len(t) + 2
    if start < len(texts):
        yield slice(start, len(texts))


class UrlModel:
    """Weights by hashed n-gram and a constant; picklable."""

    def __init__(self, weights: np.ndarray | None = None, constant: float = 0.0):
        self.weights = np.zeros(1 << BITS) if weights is None else weights
        self.constant = constant

    def fit(self, hosts: Sequence[str], paths: Sequence[str], y: np.ndarray) -> UrlModel:
        """Logistic regression by accelerated gradient steps; both classes weigh alike. The same rows give the same weights."""
        if not 0 < y.sum() < len(y):
            # nothing to tell apart: all URLs are what the labelled ones are
            self.constant = 4.0 if len(y) and y.all() else -4.0
            return self
        cells = np.union1d(gram_cells(hosts, 1), gram_cells(paths, 2))
        rows, (used, at) = cells >> BITS, np.unique(cells & ((1 << BITS) - 1), return_inverse=True)
        weight = np.where(y > 0, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))
        # the widest row bounds the curvature
        rate = 4.0 / (np.bincount(rows).max() + 1) / weight.sum()
        w, b = np.zeros(len(used)), 0.0
        w_last, b_last = w, b
        ridge = RIDGE / len(y)
        for step in range(STEPS):
            pull = step / (step + 3)
            w_at, b_at = w + pull * (w - w_last), b + pull * (b - b_last)
            z = b_at + np.bincount(rows, w_at[at], len(y))
            miss = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            w_last, b_last = w, b
            w = w_at - rate * (np.bincount(at, miss[rows], len(used)) + ridge * w_at)
            b = b_at - rate * miss.sum()
        self.weights[used], self.constant = w, float(b)
        return self

    def score(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """Probability that a URL is one to block."""
        z = np.full(len(hosts), self.constant)
        for seed, texts in enumerate((hosts, paths), 1):
            for part in groups(texts):
                cells = gram_cells(texts[part], seed)
                z[part] += np.bincount(cells >> BITS, self.weights[cells & ((1 << BITS) - 1)], part.stop - part.start)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def learn(labelled: DataFrame, url_col: str = "url", label_col: str = "blocked") -> UrlModel:
    """A model from a bounded number of labelled URLs; of several labels of a URL the largest counts."""
    host, path = host_and_path(F.col(url_col))
    rows = labelled.filter(F.col(label_col).isNotNull()).select(host.alias("host"), path.alias("path"), F.col(label_col).cast("int").alias("y"))
    rows = rows.groupBy("host", "path").agg(F.max("y").alias("y")).orderBy(F.xxhash64("host", "path"), "host", "path").limit(LABELLED_ROWS)
    got = sorted((r.host, r.path, r.y) for r in rows.collect())
    return UrlModel().fit([h for h, _, _ in got], [p for _, p, _ in got], np.array([float(y != 0) for _, _, y in got]))


class Rules:
    """Rules by host; the longest that fits a URL wins."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        self.of_host = defaultdict(list)
        for action, host, path in rules:
            self.of_host[host].append((len(host) + len(path), len(host), action == "block", action, path, host + path))

    def of(self, host: str) -> list[tuple]:
        """The rules of a host and of all hosts above it, the longest first."""
        found, at = list(self.of_host.get(host, ())), host.find(".")
        while at >= 0:
            found += self.of_host.get(host[at + 1 :], ())
            at = host.find(".", at + 1)
        return sorted(found, reverse=True)


def _cut_urls(pages: DataFrame, id_col: str, url_col: str) -> DataFrame:
    host, path = host_and_path(F.col(url_col))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), host.alias("host"), path.alias("path"))


def _by_lookup(urls: DataFrame, rules: Rules) -> DataFrame:
    held = urls.sparkSession.sparkContext.broadcast(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = {}, []
            for host, path in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if host not in of:
                    of[host] = held.value.of(host)
                out.append(next(((r[5], r[3]) for r in of[host] if path.startswith(r[4])), (None, None)))
            columns = [pa.array([r for r, _ in out], pa.string()), pa.array([a for _, a in out], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], ["page_id", "host", "path", "rule", "action"])

    return urls.mapInArrow(run, _KEEP)


def _by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each host and each host above it meets its rules; the longest fitting one is looked up per (host, path)."""
    above = F.transform(
        F.sequence(F.lit(1), F.size(F.split("host", r"\."))), lambda i: F.array_join(F.slice(F.split("host", r"\."), i, F.lit(1 << 30)), ".")
    )
    keys = urls.select("host", "path").distinct().select("host", "path", F.explode_outer(above).alias("above"))
    named = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), "action")
    met = keys.join(named, (F.col("above") == F.col("r_host")) & F.col("path").startswith(F.col("r_path")))
    rank = F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host"), F.col("action") == "block")
    best = met.groupBy(F.col("host").alias("m_host"), F.col("path").alias("m_path")).agg(
        F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), "action"), rank).alias("best")
    )
    out = urls.join(best, (F.col("host") == F.col("m_host")) & (F.col("path") == F.col("m_path")), "left")
    return out.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.col("best.action").alias("action"))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    labelled: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    rules_in_tasks: int = RULES_IN_TASKS,
) -> DataFrame:
    """One row per row of ``pages``: host and path of its URL, the rule that decides it, and the verdict.

    ``rules`` has action (allow or block), host and path. A rule fits its host and all subdomains where the path
    starts with its own; of those that fit, the longest (host and path together) decides, then that with the longer
    host, then a block. URLs that no rule fits are judged by a logistic regression on hashed n-grams of host and
    path, learned from ``labelled`` (url, blocked). The score, the probability to be one to block, is given for
    every URL.

    Up to ``rules_in_tasks`` rules are looked up in every task; a larger table is joined by host. A null URL, or one
    without ``://``, has an empty host and path, and is judged like any other. Null ids and repeated rows are kept.
    An empty table gives no rows, and without labels of both kinds all URLs get the same score. Rules with a null
    field are left out. Other columns are not read.
    """
    rules = rules.select(
        "action", F.translate("host", UPPER, UPPER.lower()).alias("host"), F.col("path")
    ).filter("action is not null and host is not null and path is not null")
    model = pages.sparkSession.sparkContext.broadcast(learn(labelled))
    urls = _cut_urls(pages, id_col, url_col)
    held = rules.limit(rules_in_tasks + 1).collect()
    ruled = _by_lookup(urls, Rules([tuple(r) for r in held])) if len(held) <= rules_in_tasks else _by_join(urls, rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices([whole], 2):
                scores = model.value.score(batch.column(1).to_pylist(), batch.column(2).to_pylist())
                learned = ["block" if s >= THRESHOLD else "allow" for s in scores]
                verdicts = [a or v for a, v in zip(batch.column(4).to_pylist(), learned, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:4], pa.array(verdicts, pa.string()), pa.array(scores)],
                    ["page_id", "host", "path", "rule", "verdict", "score"],
                )

    return ruled.mapInArrow(run, SCHEMA)
