"""Packing of tokenised documents into sequences of one window length, by best-fit decreasing."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, words_of

WINDOW = 2048
END_ID = 1
#: Tokens that are packed together at most, so that a task's memory does not grow with its share of the input.
BATCH_TOKENS = 1 << 22
#: Bytes of text that are tokenised together at most, or one text.
SLICE_BYTES = 1 << 23
#: Padding that a window may keep; windows with more are cut up and refilled.
MAX_GAP = 32
#: Distinct words whose ids a Python worker remembers.
CACHE_WORDS = 2_000_000

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class CapacityTree:
    """Open windows by remaining capacity; a segment tree finds the smallest capacity that suffices."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.any = bytearray(2 * self.size)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def add(self, capacity: int, window: int) -> None:
        self.open[capacity].append(window)
        node = self.size + capacity
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The capacity and number of the tightest window with room for ``need``, which leaves the tree."""
        node = self.size + need
        if not self.any[node]:
            # up to the first node with something in a right neighbour, then down its left edge
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                node += not self.any[node]
        capacity = node - self.size
        window = self.open[capacity].pop()
        if not self.open[capacity]:
            while node and not (node < self.size and (self.any[2 * node] or self.any[2 * node + 1])):
                self.any[node] = 0
                node >>= 1
        return capacity, window


def best_fit_decreasing(lengths: np.ndarray, window: int) -> list[list[int]]:
    """Windows as lists of item numbers; each length is from 1 to ``window``."""
    tree, windows = CapacityTree(window), []
    for item in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[item])
        found = tree.take(need)
        if found is None:
            left, number = window - need, len(windows)
            windows.append([item])
        else:
            left, number = found[0] - need, found[1]
            windows[number].append(item)
        if left:
            tree.add(left, number)
    return windows


def plan_sequences(sizes: np.ndarray, window: int, max_gap: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length), from the token counts of the documents.

    Overlong documents are first cut into full windows; the rest is packed by best-fit decreasing. Windows that
    stay more than ``max_gap`` short are strung together and cut anew into full windows, and what remains of them
    into powers of two, which need no padding. ``window`` is a power of two.
    """
    for doc in np.flatnonzero(sizes >= window).tolist():
        for start in range(0, int(sizes[doc]) // window * window, window):
            yield [(doc, start, window)]
    rest = sizes % window
    docs = np.flatnonzero(rest)
    starts = (sizes - rest)[docs]
    lengths = rest[docs]
    loose = []
    for members in best_fit_decreasing(lengths, window):
        fill = int(lengths[members].sum())
        pieces = [(int(docs[i]), int(starts[i]), int(lengths[i])) for i in members]
        if window - fill <= max_gap or fill & (fill - 1) == 0:
            yield pieces
        else:
            loose += pieces
    left = sum(p[2] for p in loose)
    room, sequence = 0, []
    for doc, start, length in loose:
        while length:
            if not room:
                room = window if left >= window else 1 << (left.bit_length() - 1)
            part = min(room, length)
            sequence.append((doc, start, part))
            start, length, room, left = start + part, length - part, room - part, left - part
            if not room:
                yield sequence
                sequence = []


class WordTokenizer:
    """Token ids by whole batches: each distinct word is encoded once and remembered.

    The tokenizer must split at white space and never join across it, so that the ids of a text are those of its
    words one after the other.
    """

    def __init__(self, spec: str, remember: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.remember = remember
        self._reset()

    def _reset(self):
        self.words, self.ids, self.ends = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _learn(self, words: pa.Array) -> None:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words.to_pylist(), add_special_tokens=False)]
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
        flat = np.fromiter((x for e in ids for x in e), np.uint32, int(ends[-1]) if len(ends) else 0)
        self.ends = np.concatenate([self.ends, ends + self.ends[-1]])
        self.ids = np.concatenate([self.ids, flat])
        self.words = pa.concat_arrays([self.words, words.cast(pa.string())])

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with ``end_id`` behind; offsets per text)."""
        codes, offsets, words = words_of(texts)
        words = words.cast(pa.string())
        # one look-up per slice, as it builds a table of all words that are remembered
        known = pc.index_in(words, value_set=self.words)
        if known.null_count + len(self.words) > self.remember:
            self._reset()
            known = pa.nulls(len(words), pa.int32())
        new = known.is_null().to_numpy(zero_copy_only=False)
        place = pc.fill_null(known, 0).to_numpy().astype(np.int64)
        place[new] = len(self.words) + np.arange(known.null_count)
        if known.null_count:
            self._learn(words.filter(pa.array(new)))
        at = place[codes]
        starts, counts = self.ends[at], self.ends[at + 1] - self.ends[at]
        before = np.concatenate([[0], np.cumsum(counts)])
        doc_ends = before[offsets]
        # one id more per text
        out = np.empty(int(before[-1]) + len(offsets) - 1, np.uint32)
        ends = doc_ends + np.arange(len(offsets))
        is_end = np.zeros(len(out), bool)
        is_end[ends[1:] - 1] = True
        out[is_end] = end_id
        take = np.repeat(starts - before[:-1], counts) + np.arange(int(before[-1]))
        out[~is_end] = self.ids[take]
        return out, ends


_tokenizers: dict[str, WordTokenizer] = {}


def _tokenizer(spec: str) -> WordTokenizer:
    if spec not in _tokenizers:
        _tokenizers.clear()
        _tokenizers[spec] = WordTokenizer(spec)
    return _tokenizers[spec]


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = END_ID,
    batch_tokens: int = BATCH_TOKENS,
    max_gap: int = MAX_GAP,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents and their places in sequences of at most ``window`` tokens.

    ``tokenizer`` is the path of a tokenizer file on the driver; its content is broadcast (its size does not depend
    on the data). Each task packs its own documents, ``batch_tokens`` at a time, so nothing is shuffled and no key
    can be hot. A sequence id is the number of the partition, shifted by 40 bits, plus a count.

    A null or empty text is the end id alone. Repeated rows and equal ids are packed row by row. An empty table gives
    no rows. Other columns of ``docs`` are not read. With ``with_ids`` the ids of each piece follow, in ``ids``.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spec = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text(encoding="utf-8"))
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def emit(chunks, base):
        doc_ids = pa.concat_arrays([c[0] for c in chunks])
        flat = np.concatenate([c[1] for c in chunks])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(c[2]) for c in chunks]))])
        sizes = np.diff(ends)
        rows, count = [], 0
        for sequence in plan_sequences(sizes, window, max_gap):
            offset = 0
            for doc, start, length in sequence:
                rows.append((doc, start, length, base + count, offset))
                offset += length
            count += 1
        doc, start, length, sequence, offset = np.array(rows, np.int64).reshape(-1, 5).T
        first = ends[doc] + start
        parts = [flat[a:b] for a, b in zip(first.tolist(), (first + length).tolist(), strict=True)]
        crc = pa.array([zlib.crc32(p.astype("<u4").tobytes()) for p in parts], pa.int64())
        columns = [doc_ids.take(pa.array(doc)), start, length, crc, sizes[doc], sequence, offset]
        columns = [c if isinstance(c, pa.Array) else pa.array(np.ascontiguousarray(c), pa.int64()) for c in columns]
        out = pa.RecordBatch.from_arrays(columns, names)
        if with_ids:
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32()),
                pa.array(np.concatenate(parts).astype(np.int32), pa.int32()),
            )
            out = out.append_column("ids", lists)
        return out, count

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(spec.value)
        base, chunks, held = TaskContext.get().partitionId() << 40, [], 0
        for batch in slices(batches, 1, SLICE_BYTES):
            ids, ends = coder.encode(batch.column(1), end_id)
            chunks.append((batch.column(0), ids, ends))
            held += len(ids)
            if held >= batch_tokens:
                out, count = emit(chunks, base)
                yield out
                base, chunks, held = base + count, [], 0
        if chunks:
            yield emit(chunks, base)[0]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(pack, SCHEMA + (", ids array<int>" if with_ids else ""))
