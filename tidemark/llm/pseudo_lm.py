"""Masked pseudo-likelihood: a small network predicts each token of a text from the tokens on both its sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import mix64, slices, stored, word_hashes, words_of
from tidemark.session import cut_lineage

#: Words are hashed into so many tokens at least, and into so many times the root of the distinct words; the two
#: numbers past them stand for the ends of a text.
TOKENS, TOKENS_PER_ROOT = 1 << 12, 6
#: Tokens on either side that are seen, units of the hidden layer.
SIDE, HIDDEN = 2, 16
#: Words above this part of all words lie in each task, the others are joined; either way gives the same score.
COMMON = 1 << 18
#: What words that were not counted have together, in each token.
UNSEEN = 0.5
#: Tokens of a training step, and its size.
STEP_TOKENS, RATE = 8192, 0.5
#: Rows of a parameter block, and groups in which blocks of many tasks are averaged first.
BLOCK_ROWS, SALTS = 512, 32


class Network:
    """Left and right tokens -> hidden units -> the class of the token between; counts give the token in its class.

    Each place of the window has its own table of token vectors; their sum and a constant go through tanh. There are
    as many classes as the root of the tokens, in whole rows of a parameter block.
    """

    def __init__(self, counts: np.ndarray, seed: int = 3):
        self.size = len(counts)
        classes = self.classes = HIDDEN * max(1, round(self.size**0.5 / HIDDEN))
        # frequent tokens get classes of few members
        order = np.argsort(-counts, kind="stable")
        mass = np.cumsum(np.sqrt(counts[order] + 1.0))
        self.class_of = np.empty(len(counts), np.int64)
        self.class_of[order] = np.minimum((mass / mass[-1] * classes).astype(np.int64), classes - 1)
        smooth = counts + UNSEEN
        self.log_count = np.log(smooth)
        self.within = np.log(smooth / np.bincount(self.class_of, smooth, classes)[self.class_of])
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.1, (2 * SIDE, self.size + 2, HIDDEN)).astype(np.float32)
        # the last layer starts at the classes' shares
        share = np.bincount(self.class_of, smooth, classes)
        self.out = np.vstack([rng.normal(0, 0.1, (HIDDEN, classes)), np.log(share / share.sum())[None]]).astype(np.float32)
        self.const = np.zeros((1, HIDDEN), np.float32)

    def parameters(self) -> np.ndarray:
        """All weights, as rows of HIDDEN numbers."""
        return np.vstack([self.tables.reshape(-1, HIDDEN), self.const, self.out.reshape(-1, HIDDEN)])

    def load(self, rows: np.ndarray) -> None:
        n = 2 * SIDE * (self.size + 2)
        self.tables, self.const = rows[:n].reshape(self.tables.shape).copy(), rows[n : n + 1].copy()
        self.out = rows[n + 1 :].reshape(HIDDEN + 1, self.classes).copy()

    def _forward(self, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden units and logits of the classes, at most 0; worked in place, as fresh memory costs more than sums."""
        hidden = self.tables[0].take(sides[0], 0)
        for table, side in zip(self.tables[1:], sides[1:], strict=True):
            hidden += table.take(side, 0)
        hidden += self.const
        np.tanh(hidden, out=hidden)
        logits = hidden @ self.out[:-1]
        logits += self.out[-1]
        logits -= logits.max(1, keepdims=True)
        return hidden, logits

    def log_probs(self, sides: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Log-probability of each token given the tokens at its sides."""
        _, logits = self._forward(sides)
        own = logits[np.arange(len(targets)), self.class_of[targets]]
        return own - np.log(np.exp(logits, out=logits).sum(1)) + self.within[targets]

    def train(self, sides: np.ndarray, targets: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean loss; a table row moves by the mean over its own tokens."""
        hidden, error = self._forward(sides)
        np.exp(error, out=error)
        error /= error.sum(1, keepdims=True)
        error[np.arange(len(targets)), self.class_of[targets]] -= 1
        back = error @ self.out[:-1].T
        back *= 1 - hidden * hidden
        self.out[:-1] -= rate / len(targets) * (hidden.T @ error)
        self.out[-1] -= rate / len(targets) * error.sum(0)
        self.const -= rate * back.mean(0)
        for table, side in zip(self.tables, sides, strict=True):
            order = np.argsort(side, kind="stable")
            tokens = side.take(order)
            starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
            sums = np.add.reduceat(back.take(order, 0), starts)
            times = np.diff(np.append(starts, len(order)))[:, None]
            # a token seen rarely in this step moves little, one seen often by its mean
            sums *= (rate / (times + 8)).astype(np.float32)
            moved = tokens.take(starts)
            table[moved] = table.take(moved, 0) - sums


def tokens_of(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes % np.uint64(size)).astype(np.int64)


def token_windows(texts: pa.Array, size: int = TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the tokens at each place to the sides of each token, the tokens, offsets per text)."""
    codes, offsets, words = words_of(texts)
    tokens = tokens_of(word_hashes(words), size)[codes]
    return sides_of(tokens, offsets, size), tokens, offsets


def sides_of(tokens: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The tokens at each place to the sides of each token."""
    n = len(offsets) - 1
    # each text stands between SIDE marks for its begin and its end
    laid = np.full(len(tokens) + 2 * SIDE * n, size + 1, np.uint16 if size + 1 < 1 << 16 else np.uint32)
    text = np.repeat(np.arange(n), np.diff(offsets))
    at = np.arange(len(tokens)) + SIDE * (2 * text + 1)
    laid[at] = tokens
    begins = offsets[:-1] + 2 * SIDE * np.arange(n)
    for i in range(SIDE):
        laid[begins + i] = size
    shifts = [*range(-SIDE, 0), *range(1, SIDE + 1)]
    return np.stack([laid[at + s] for s in shifts])


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.col(text_col).alias("text"))


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """How often each word occurs in all texts, by its 64-bit hash: a stored table that grows with the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            codes, _, words = words_of(batch.column(0))
            n = np.bincount(codes, minlength=len(words))
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(word_hashes(words).view(np.int64)[seen]), pa.array(n[seen])], ["word", "n"])

    rows = _texts(docs, text_col).mapInArrow(count, "word long, n long")
    return stored(rows.groupBy("word").agg(F.sum("n").alias("n")))


def token_counts(counts: DataFrame) -> np.ndarray:
    """How often each token occurs, by the counted words, which say how many tokens there are.

    Only these, some times the root of the distinct words, reach the driver.
    """
    size = max(TOKENS, round(TOKENS_PER_ROOT * counts.count() ** 0.5))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            words, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            np.add.at(total, tokens_of(words.view(np.uint64), size), n)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["token", "n"])

    rows = counts.select("word", "n").mapInArrow(add, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for row in rows.collect():
        out[row.token] = row.n
    return out


def _average(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The weighted mean of the blocks of a group, one after the other."""
    total, weight = 0.0, 0
    for batch in batches:
        for n, values in zip(batch.column("n").to_pylist(), batch.column("block").to_pylist(), strict=True):
            total, weight = total + np.frombuffer(values, np.float32).astype(np.float64) * n, weight + n
    mean = (total / weight).astype(np.float32).tobytes()
    yield pa.RecordBatch.from_arrays(
        [pa.array([key[0].as_py()], pa.int32()), pa.array([weight], pa.int64()), pa.array([mean], pa.binary())], ["part", "n", "block"]
    )


def train_network(docs: DataFrame, text_col: str = "text", epochs: int = 1, counts: DataFrame | None = None) -> Network:
    """A network trained on all texts, whose words ``counts`` has, or are counted.

    In each epoch every task trains a copy of the network on its own texts, in numpy; the copies are averaged by
    the tokens that they saw, block by block, first in salted groups. Only the averaged weights reach the driver;
    their number grows with the root of the distinct words.
    """
    sc = docs.sparkSession.sparkContext
    network = Network(token_counts(word_counts(docs, text_col) if counts is None else counts))
    for _ in range(epochs):
        shared = sc.broadcast(network)

        def train(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            own = Network.__new__(Network)
            own.__dict__.update({k: v.copy() if isinstance(v, np.ndarray) else v for k, v in shared.value.__dict__.items()})
            seen = 0
            for batch in slices(batches, 0):
                sides, tokens, _ = token_windows(batch.column(0), own.size)
                # texts lie one after the other; a fixed shuffle mixes them within a step's reach
                order = np.random.default_rng(len(tokens)).permutation(len(tokens))
                for at in range(0, len(order), STEP_TOKENS):
                    pick = order[at : at + STEP_TOKENS]
                    own.train(sides[:, pick], tokens[pick], RATE)
                seen += len(tokens)
            if seen:
                rows = own.parameters()
                for part, at in enumerate(range(0, len(rows), BLOCK_ROWS)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([part], pa.int32()), pa.array([seen], pa.int64()), pa.array([rows[at : at + BLOCK_ROWS].tobytes()], pa.binary())],
                        ["part", "n", "block"],
                    )

        schema = "part int, n long, block binary"
        blocks = _texts(docs, text_col).mapInArrow(train, schema)
        blocks = blocks.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
        means = blocks.groupBy("part", "salt").applyInArrow(_average, schema).groupBy("part").applyInArrow(_average, schema)
        got = sorted(cut_lineage(means).collect(), key=lambda r: r.part)
        if got:
            network.load(np.concatenate([np.frombuffer(r.block, np.float32) for r in got]).reshape(-1, HIDDEN))
    return network


def score_documents(
    docs: DataFrame,
    network: Network | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    counts: DataFrame | None = None,
) -> DataFrame:
    """One row per row of ``docs``: its tokens, the sum of their log-probabilities, and the mean.

    Each token is masked in turn and predicted from SIDE tokens to its left and right by a network that was trained
    on all texts of ``docs`` (or by ``network``). A word is a run of anything but ASCII white space, its token a hash
    of it. The share that a word has of its token comes from the counts of all words (or from ``counts``, those that
    ``network`` was trained with), a table that leaves no word out; words it lacks share UNSEEN. A ``network`` without
    counts knows tokens only, and their probabilities are summed.

    A null, empty or blank text has no tokens, a sum of 0 and a null mean. Repeated rows and equal ids are scored
    row by row. An empty table gives no rows. Other columns are not read.
    """
    spark: SparkSession = docs.sparkSession
    if network is None:
        counts = word_counts(docs, text_col) if counts is None else counts
        network = train_network(docs, text_col, counts=counts)
    shared, whole = spark.sparkContext.broadcast(network), counts is not None
    known = np.zeros((2, 0), np.int64)
    if whole:
        # fewer than COMMON words can be above that part of all
        least = (counts.agg(F.sum("n")).first()[0] or 0) / COMMON
        common = counts.filter(F.col("n") > least).select("word", "n").toPandas().sort_values("word")
        known = np.stack([common["word"].to_numpy(np.int64), common["n"].to_numpy(np.int64)])
    common = spark.sparkContext.broadcast(known)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, (known, times) = shared.value, common.value
        for batch in slices(batches, 2):
            codes, offsets, words = words_of(batch.column(2))
            hashes = word_hashes(words)
            tokens = tokens_of(hashes, network.size)[codes]
            sides = sides_of(tokens, offsets, network.size)
            # a zero behind the last token keeps the sums of empty texts in range
            each = np.zeros(len(tokens) + 1)
            for at in range(0, len(tokens), STEP_TOKENS):
                part = slice(at, at + STEP_TOKENS)
                each[:-1][part] = network.log_probs(sides[:, part], tokens[part])
            n = np.diff(offsets)
            pairs, often = np.zeros(0, np.int64), np.zeros(0, np.int64)
            if whole:
                # the token's count goes, the word's comes: here or from the table
                hashes = hashes.view(np.int64)
                place = np.searchsorted(known, hashes)
                here = np.append(known, 0)[place] == hashes
                here &= place < len(known)
                each[:-1] += np.where(here, np.log(np.append(times, 1)[place]), 0.0)[codes] - network.log_count[tokens]
                rare = ~here[codes]
                text = np.repeat(np.arange(len(n)), n)
                pairs, often = np.unique(text[rare] * len(words) + codes[rare], return_counts=True)
            logs = np.where(n > 0, np.add.reduceat(each, offsets[:-1]), 0.0)
            row, none = batch.column(0).to_numpy(), np.zeros(len(pairs), np.int64)
            # a text's own numbers travel as a word that occurs no times, its row scattered over the tasks
            own = [mix64(row.astype(np.uint64)).view(np.int64), np.zeros(len(n), np.int64), n, logs]
            rest = [hashes[pairs % len(words)] if len(pairs) else none, often, none, none.astype(float)]
            ids = pa.concat_arrays([batch.column(1), pa.nulls(len(pairs), pa.int64())])
            rows = pa.array(np.concatenate([row, row[pairs // len(words)] if len(pairs) else none]))
            columns = [pa.array(np.concatenate([a, b])) for a, b in zip(own, rest, strict=True)]
            yield pa.RecordBatch.from_arrays([rows, ids, *columns], ["row", "doc_id", "word", "times", "n_tokens", "log_prob"])

    # a row's number is used within this one scan only
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = rows.mapInArrow(score, "row long, doc_id long, word long, times long, n_tokens long, log_prob double")
    if whole:
        found = parts.join(counts.select("word", "n"), "word", "left")
        log = F.col("log_prob") + F.col("times") * F.log(F.coalesce(F.col("n").cast("double"), F.lit(UNSEEN)))
        parts = found.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum(log).alias("log_prob"))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob")
    return parts.select("doc_id", "n_tokens", "log_prob", mean)
