"""Toxicity by compression distance: one zstandard dictionary of toxic text, one of ordinary text."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored

#: Labelled rows that the dictionaries and the calibration learn from, at most; their texts are read whole.
TOXIC_ROWS, ORDINARY_ROWS, CALIBRATION_ROWS = 1500, 3000, 6000
#: Windows of ordinary texts, and stretches of toxic ones, that train the dictionaries: a sample over all of them.
LEARN_WINDOWS = 40_000
#: A row is held out where the CRC-32 of its id modulo PARTS is HELD; the part CALIBRATE fits the scores.
PARTS, HELD, CALIBRATE = 4, 2, 3
#: A document counts as toxic from this score on.
THRESHOLD = 0.3
#: Words of a window; longer words are cut.
WORDS, WORD_CHARS = 8, 40
TAIL = "\n" * 8
FEATURES = 10
#: Bytes of the dictionaries, code points of the pieces that set toxic text apart, and how clearly they must.
TOXIC_BYTES, ORDINARY_BYTES = 1024, 16384
PIECE, EXCESS, EVIDENCE = 5, 20.0, 25.0

SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def words(text: str) -> list[str]:
    out = []
    for word in text.lower().split():
        if len(word) <= WORD_CHARS:
            out.append(word)
        else:
            out += [word[i : i + WORD_CHARS] for i in range(0, len(word), WORD_CHARS)]
    return out


def windows(text: str) -> list[bytes]:
    """The words of a text, a few at a time, with blanks around them.

    The compressor looks for no match in the last eight bytes; so many more stand behind the last word.
    """
    ws = words(text)
    return [f" {' '.join(ws[i : i + WORDS])} {TAIL}".encode("utf-8", "replace") for i in range(0, len(ws), WORDS)]


def _pieces(text: str) -> set[str]:
    out = set()
    for word in set(words(text)):
        padded = f" {word} "
        out.update(padded[i : i + PIECE] for i in range(len(padded) - PIECE + 1))
    return out


def telling_pieces(toxic: list[str], ordinary: list[str]) -> set[str]:
    """Pieces that more toxic than ordinary texts hold, by rate and by the G statistic of the counts."""
    a, b = Counter(), Counter()
    for counter, texts in ((a, toxic), (b, ordinary)):
        for text in texts:
            counter.update(_pieces(text))
    return {piece for piece, k in a.items() if tells(k, b[piece], len(toxic), len(ordinary))}


def tells(k: int, j: int, n: int, m: int) -> bool:
    """Whether a piece that k of n toxic and j of m ordinary texts hold sets toxic text apart."""

    def part(k: int, size: int, p: float) -> float:
        return (k * math.log(k / (size * p)) if k else 0.0) + ((size - k) * math.log((size - k) / (size * (1 - p))) if size > k else 0.0)

    p = (k + j) / (n + m)
    return k > 0 and (k + 0.5) / (n + 1) > EXCESS * (j + 0.5) / (m + 1) and p < 1 and 2 * (part(k, n, p) + part(j, m, p)) > EVIDENCE


def telling_runs(texts: list[str], pieces: set[str]) -> list[bytes]:
    """The stretches of words that telling pieces cover."""
    out = []
    for text in texts:
        for word in words(text):
            padded = f" {word} "
            start = end = -1
            for i in range(len(padded) - PIECE + 1):
                if padded[i : i + PIECE] in pieces:
                    if i > end and end >= 0:
                        out.append(padded[start:end].encode("utf-8", "replace"))
                        start = i
                    start = i if end < 0 else start
                    end = i + PIECE
            if end >= 0:
                out.append(padded[start:end].encode("utf-8", "replace"))
    return out


def dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary trained on the samples; what room is left gets the most frequent ones it lacks.

    The trainer gives back less than asked for, or nothing, where there is little to train on.
    """
    try:
        content = zstd.train_dictionary(size, samples).as_bytes()
    except zstd.ZstdError:
        content = b""
    extra = b""
    for sample, _ in sorted(Counter(samples).items(), key=lambda x: (-x[1], x[0])):
        if len(content) + len(extra) + len(sample) <= size and sample not in content and sample not in extra:
            extra += sample
    return content + extra


class Distance:
    """Compressed length of windows under the ordinary dictionary less that under both together.

    The toxic dictionary, or as many zero bytes, is laid behind the ordinary one, so a window that holds nothing toxic
    finds the same matches at the same distances either way, and a toxic one is shorter.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        params = zstd.ZstdCompressionParameters(
            window_log=17,
            chain_log=17,
            hash_log=16,
            min_match=5,
            strategy=zstd.STRATEGY_DFAST,
            write_content_size=False,
            write_checksum=False,
            write_dict_id=False,
        )

        def compressor(content: bytes):
            # a dictionary needs eight bytes at least
            data = zstd.ZstdCompressionDict(content.rjust(8), dict_type=zstd.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=params)
            return zstd.ZstdCompressor(compression_params=params, dict_data=data).compress

        self.plain, self.both = compressor(ordinary + bytes(len(toxic))), compressor(ordinary + toxic)

    def features(self, text: str) -> list[float]:
        """What the gains of a text's windows look like: their largest, and how many pass which length."""
        gains = sorted((len(self.plain(w)) - len(self.both(w)) for w in windows(text)), reverse=True)
        n = max(1, len(gains))
        passed = [sum(g >= least for g in gains) for least in (2, 3, 4, 5)]
        top = gains[:3] + [0] * (3 - len(gains[:3]))
        return [top[0], sum(top), *[math.log1p(p) for p in passed], *[math.sqrt(p / n) for p in passed]]


def fit_rising(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression in which no column counts against a text; the first is the constant."""
    use = list(range(x.shape[1]))
    while True:
        w = fit_logistic(x[:, use], y)
        if not use or w[1:].min() >= 0:
            break
        use.pop(int(np.argmin(w[1:])))
    out = np.zeros(x.shape[1] + 1)
    out[[0, *[i + 1 for i in use]]] = w
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression by Newton steps; the first is the constant."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def best_cut(logits: np.ndarray, y: np.ndarray) -> float:
    """The logit from which on calling a text toxic gives the best F1."""
    order = np.argsort(-logits, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    ends = np.append(logits[order][1:] < logits[order][:-1], True)
    at = int(np.argmax(np.where(ends, f1, -1)))
    lower = logits[order][at + 1] if at + 1 < len(y) else logits[order][at] - 1
    return float((logits[order][at] + lower) / 2)


class Model:
    """Dictionaries, weights and a calibrated cut; picklable."""

    def __init__(self, samples: list[bytes], runs: list[bytes]):
        self.ordinary = dictionary(samples, ORDINARY_BYTES)
        self.toxic = dictionary(runs, TOXIC_BYTES)
        self._distance = None
        self.mean, self.scale, self.weights, self.shift = np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES + 1), 0.0

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Weights and cut by the features and labels of rows that the dictionaries did not learn from."""
        if 0 < y.sum() < len(y):
            self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-6)
            x = (x - self.mean) / self.scale
            self.weights = fit_rising(x, y)
            logits = self.weights[0] + x @ self.weights[1:]
            # the best cut gets the score that counts as toxic, unless it is less sure than that score says
            self.shift = min(0.0, math.log(THRESHOLD / (1 - THRESHOLD)) - best_cut(logits, y))
        else:
            # nothing to learn from: no text is toxic, or all are
            self.weights[0] = 4.0 if len(y) and y.all() else -4.0

    def __getstate__(self):
        return {**self.__dict__, "_distance": None}

    def features(self, text: str) -> list[float]:
        if self._distance is None:
            self._distance = Distance(self.ordinary, self.toxic)
        return self._distance.features(text)

    def score(self, texts: list[str]) -> np.ndarray:
        x = (np.array([self.features(t) for t in texts]).reshape(-1, FEATURES) - self.mean) / self.scale
        logits = self.weights[0] + x @ self.weights[1:] + self.shift
        return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def part_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(PARTS))


def _sample(texts: DataFrame, cut: Callable[[str], list[bytes]]) -> list[bytes]:
    """LEARN_WINDOWS of what ``cut`` finds in whole texts, those with the least hashes of text and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = cut(text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(found), pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.binary())],
                    ["key", "place", "window"],
                )

    found = texts.select("key", "text").mapInArrow(run, "key long, place long, window binary")
    order = F.xxhash64(F.lit(5), "key", "place")
    least = found.select(order.alias("o"), "window").orderBy("o", "window").limit(LEARN_WINDOWS)
    return [bytes(r.window) for r in least.collect()]


def _telling(texts: DataFrame) -> set[str]:
    """The telling pieces of whole texts: tasks count them and only those that tell reach the driver."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            for text, toxic in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = [p.encode("utf-8", "replace") for p in _pieces(text)]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), pa.array([toxic] * len(found), pa.int32())], ["piece", "toxic"])

    sizes = {r.toxic: r["count"] for r in texts.groupBy("toxic").count().collect()}
    n, m = sizes.get(1, 0), sizes.get(0, 0)
    if not n or not m:
        return set()

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([tells(k, j, n, m) for k, j in zip(batch["k"].to_pylist(), batch["j"].to_pylist(), strict=True)], pa.bool_()))

    pieces = texts.select("text", "toxic").mapInArrow(cut, "piece binary, toxic int")
    counts = pieces.groupBy("piece").agg(F.sum("toxic").alias("k"), F.sum(1 - F.col("toxic")).alias("j")).filter("k > 0")
    return {bytes(r.piece).decode() for r in counts.mapInArrow(pick, "piece binary, k long, j long").collect()}


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Model:
    """A model from a bounded sample of labelled rows; the held-out part is never read.

    The sample takes the rows whose ids have the least hashes. Their whole texts are read in tasks; samples of their
    windows, the telling pieces and the features of the calibration rows reach the driver.
    """
    known = labels.filter("toxic is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("part", part_of(F.col("l_id"))).filter(F.col("part") != HELD)
    order = F.xxhash64(F.lit(11), "l_id")
    fit, check = known.filter(F.col("part") != CALIBRATE), known.filter(F.col("part") == CALIBRATE)
    picked = (
        fit.filter("toxic = 1").orderBy(order).limit(TOXIC_ROWS)
        .unionByName(fit.filter("toxic = 0").orderBy(order).limit(ORDINARY_ROWS))
        .unionByName(check.orderBy(order).limit(CALIBRATION_ROWS))
    )
    read = docs.select(F.col(id_col).cast("long").alias("d_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # the sample's rows are bounded by its three limits
    got = read.join(F.broadcast(picked), F.col("d_id") == F.col("l_id"))
    got = stored(got.select("text", (F.col("toxic") != 0).cast("int").alias("toxic"), "part", F.xxhash64("text").alias("key")))
    # copies of a text say nothing more
    texts = stored(got.filter(F.col("part") != CALIBRATE).drop("part").dropDuplicates(["toxic", "text"]))
    pieces = _telling(texts)
    samples = _sample(texts.filter("toxic = 0"), lambda text: [w[: -len(TAIL)] for w in windows(text)])
    runs = _sample(texts.filter("toxic = 1"), lambda text: telling_runs([text], pieces)) if pieces else []
    model = Model(samples, runs)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            x = [model.features(text) for text in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    check = got.filter(F.col("part") == CALIBRATE).select("text", "toxic").mapInArrow(measure, "x array<double>, toxic int")
    rows = sorted((list(r.x), r.toxic) for r in check.collect())
    model.calibrate(np.array([x for x, _ in rows]).reshape(-1, FEATURES), np.array([label for _, label in rows], float))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: whether it was held out, its score, and whether that counts as toxic.

    Words that set labelled toxic texts apart train one dictionary, ordinary windows the other. Each window of a
    whole text is compressed under both; the gains, by calibrated thresholds, make the score. Only the text is its
    input.

    A null text counts as empty; an empty text has no windows and gets the score of a text without gains. A null id
    is not held out. Of several labels of an id the largest counts; an id that several rows share labels all of
    them. Without labels of both kinds every score is alike. An empty table gives no rows. Other columns are not
    read.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            scores = model.value.score([t or "" for t in part.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    held = F.coalesce(part_of(F.col(id_col).cast("long")) == HELD, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose score counts as toxic; all its columns, which pass through the scoring task."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, at):
            scores = model.value.score([t or "" for t in part.column(at).to_pylist()])
            yield part.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
