"""Removal of passages that occur more than once, by seeds and their extension."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import gram_hashes, mix64, numbered_texts, slices, stored, word_hashes, words_of
from tidemark.session import cut_lineage

#: Words of a passage that is removed where it repeats.
LENGTH = 35
#: Words of a seed. Every passage of LENGTH words holds LENGTH - SEED + 1 seeds, and so at least one anchor.
SEED = 8
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def rightmost_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values the place of its least one, the rightmost of equals."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    place, least, have = np.arange(len(values)), values, 1
    while have < width:
        step = min(have, width - have)
        a, b = least[: len(least) - step], least[step:]
        right = b <= a
        least = np.where(right, b, a)
        place = np.where(right, place[step:], place[: len(place) - step])
        have += step
    return place


class Windows:
    """Seeds and passages of a batch of texts, laid end to end."""

    def __init__(self, texts: pa.Array, length: int, seed: int):
        self.codes, self.offsets, self.words = words_of(texts)
        hashes = word_hashes(self.words)
        self.hashes = hashes[self.codes]
        self.seeds = gram_hashes(self.hashes, seed)
        self.anchor = rightmost_minima(self.seeds, length - seed + 1)
        # a passage that runs over the end of its text is none
        self.text = np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.offsets))
        n = len(self.anchor)
        self.real = np.flatnonzero(self.text[:n] == self.text[length - 1 : length - 1 + n]) if n else np.zeros(0, np.int64)

    def joined(self) -> list[memoryview]:
        """The words of each text, joined by one blank, in UTF-8."""
        return join_words(self.codes, self.offsets, self.words)


def join_words(codes: np.ndarray, offsets: np.ndarray, words: pa.Array) -> list[memoryview]:
    """Texts of words by code, joined by one blank, in UTF-8."""
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words.cast(pa.string()).take(pa.array(codes)))
    texts = pc.binary_join(lists, " ").cast(pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[: len(texts) + 1].tolist()
    data = memoryview(texts.buffers()[2] or b"")
    return [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _seed(length: int, seed: int):
    """Per text: its words' SHA-256 and its distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            w = Windows(batch.column(2), length, seed)
            spots = np.unique(w.anchor[w.real])
            ends = np.searchsorted(spots, w.offsets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(np.diff(w.offsets)),
                    pa.array([hashlib.sha256(t).hexdigest() for t in w.joined()], pa.string()),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(w.seeds[spots].view(np.int64))),
                ],
                ["row", "doc_id", "n_words", "sha", "anchors"],
            )

    return run


def _extend(length: int, seed: int):
    """The passages around anchors that repeat: two hashes of the whole passage, row and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            w = Windows(batch.column(1), length, seed)
            anchors = batch.column(2)
            of_text = np.repeat(np.arange(len(anchors)), np.diff(anchors.offsets.to_numpy()))
            wanted = np.unique(anchors.flatten().to_numpy().view(np.uint64) ^ mix64(of_text.astype(np.uint64)))
            place = w.anchor[w.real]
            mine = w.seeds[place] ^ mix64(w.text[w.real].astype(np.uint64))
            starts = w.real[np.isin(mine, wanted)]
            full = gram_hashes(w.hashes, length)
            # from the bytes of the words anew, so that words that share the first hash do not share this one
            check = gram_hashes(word_hashes(w.words, 1)[w.codes], length)
            text = w.text[starts]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(full[starts].view(np.int64)),
                    pa.array((check[starts] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                    batch.column(0).take(pa.array(text)),
                    pa.array((starts - w.offsets[text]).astype(np.int32)),
                    batch.column(3).take(pa.array(text)),
                ],
                ["h", "check", "row", "start", "single"],
            )

    return run


def _cut(length: int):
    """Per text: words removed and SHA-256 of the others, given the starts of its repeated passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            codes, offsets, words = words_of(batch.column(1))
            starts = batch.column(2)
            first = np.repeat(offsets[:-1], np.diff(starts.offsets.to_numpy())) + starts.flatten().to_numpy()
            # passages are of one length, so covered words follow from counts of starts and ends
            edge = np.bincount(first, minlength=len(codes) + 1) - np.bincount(first + length, minlength=len(codes) + 1)[: len(codes) + 1]
            kept = np.cumsum(edge)[: len(codes)] == 0
            ends = np.concatenate([[0], np.cumsum(kept)])[offsets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.diff(offsets) - np.diff(ends)),
                    pa.array([hashlib.sha256(t).hexdigest() for t in join_words(codes[kept], ends, words)], pa.string()),
                ],
                ["row", "removed", "cut_sha"],
            )

    return run


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, seed: int = SEED
) -> DataFrame:
    """One row per row of ``docs``: its words, how many lie in a repeated passage, and the SHA-256 of the others.

    A passage is ``length`` consecutive words of one text; it repeats when the same words start anywhere else, in
    the same text as well. Words are runs of anything but ASCII white space.

    Texts with the same words are looked at once: such copies repeat as a whole. Of the others, anchors are the
    minima of winnowed seeds of ``seed`` words: each passage holds one, and equal passages hold equal ones at the
    same place. Texts meet on anchors that occur twice; a shared anchor is extended both ways to the passages that
    chose it, and those that occur twice are removed. A common passage costs one row per occurrence, never a pair.

    A null text has no words; texts shorter than ``length`` lose none. Repeated rows and equal ids are rows of their
    own, so a repeated text of ``length`` words or more loses all. An empty table gives no rows. Other columns are
    not read. Rows are numbered and stored once, as their texts are read twice.
    """
    read = numbered_texts(docs, id_col, text_col)
    seeded = read.mapInArrow(_seed(length, seed), "row long, doc_id long, n_words long, sha string, anchors array<long>")
    seeded = cut_lineage(seeded)
    groups = seeded.groupBy("sha").agg(F.min("row").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    # kept apart, as below: the join has a shuffle of its own on either side and can split a hot group
    seeded = seeded.join(cut_lineage(groups), "sha", "left")
    whole = F.coalesce(F.col("copies") > 1, F.lit(False)) & (F.col("n_words") >= length)
    seeded = seeded.withColumn("whole", whole)

    # one of each group of copies meets the other texts
    met = seeded.filter("rep is null or rep = row").select("row", F.explode("anchors").alias("anchor"))
    twice = cut_lineage(met.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    spots = met.join(twice, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
    spots = spots.join(seeded.select("row", (~F.col("whole")).alias("single")), "row")
    texts = stored(read.select("row", "text").join(spots, "row"))
    passages = texts.mapInArrow(_extend(length, seed), "h long, check int, row long, start int, single boolean")
    again = cut_lineage(passages.groupBy("h", "check").agg(F.count("*").alias("n")).filter("n > 1").drop("n"))
    starts = passages.filter("single").join(again, ["h", "check"]).groupBy("row").agg(F.collect_list("start").alias("starts"))
    cut = texts.select("row", "text").join(starts, "row").mapInArrow(_cut(length), "row long, removed long, cut_sha string")
    done = seeded.drop("anchors").join(cut, "row", "left")
    return done.select(
        "doc_id",
        "n_words",
        F.when(F.col("whole"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("whole"), F.lit(EMPTY_SHA)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
    )
