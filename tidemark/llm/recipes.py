"""Exact deduplication by content-defined chunk recipes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import numbered_texts, slices, with_row_number
from tidemark.session import cut_lineage

#: Bytes of a chunk: least, mean beyond that, most.
LEAST, MEAN, MOST = 512, 2048, 16384
#: Bytes that the rolling hash of a cut sees.
SPAN = 32
DIGEST_BYTES = 16

_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([i]), digest_size=4).digest() for i in range(256)), "<u4").copy()


def cut_points(data: np.ndarray, least: int = LEAST, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of the chunks of one text's bytes.

    A cut lies where the gear hash of the last 32 bytes has its high bits at zero; a chunk has ``least`` to ``most``
    bytes, the last one may have fewer. The same bytes give the same cuts.
    """
    n = len(data)
    if n <= least:
        return [n] if n else []
    h, width = _GEAR[data], 1
    while width < SPAN:
        # h[i] covers 2 * width bytes: the newer half, and the older half shifted
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    spots = np.flatnonzero(h < np.uint32(2**32 // mean)) + 1
    ends, start = [], 0
    while n - start > least:
        at = int(np.searchsorted(spots, start + least))
        end = int(spots[at]) if at < len(spots) else n
        end = min(end, start + most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def _chunks(texts: pa.Array) -> Iterator[list[memoryview]]:
    """The chunks of each text of a batch."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1].tolist()
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    for a, b in pairwise(offsets):
        part = data[a:b]
        ends = cut_points(part)
        yield [part[x:y].data for x, y in pairwise([0, *ends])]


def _digest(chunk, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def chunk_recipes(docs: DataFrame, id_col: str, text_col: str, digest_bytes: int, row_col: str | None = None) -> DataFrame:
    """Per row: row number, id, SHA-256 of the text, and the digests of its chunks in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2):
            shas, recipes = [], []
            for chunks in _chunks(batch.column(2)):
                sha = hashlib.sha256()
                for c in chunks:
                    sha.update(c)
                shas.append(sha.hexdigest())
                recipes.append([_digest(c, digest_bytes) for c in chunks])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(shas, pa.string()), pa.array(recipes, pa.list_(pa.binary()))],
                ["row", "doc_id", "text_sha256", "recipe"],
            )

    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "row long, doc_id long, text_sha256 string, recipe array<binary>")


def distinct_chunks(docs: DataFrame, text_col: str, digest_bytes: int) -> DataFrame:
    """Distinct chunks of all texts: digest and bytes. Copies within a batch leave the task once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0, 1 << 22):
            found: dict[tuple[bytes, bytes], None] = {}
            for chunks in _chunks(batch.column(0)):
                for c in chunks:
                    found[_digest(c, digest_bytes), bytes(c)] = None
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in found], pa.binary()), pa.array([c for _, c in found], pa.binary())], ["digest", "chunk"]
            )

    return docs.select(F.col(text_col).alias("text")).mapInArrow(cut, "digest binary, chunk binary").distinct()


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest_bytes: int = DIGEST_BYTES,
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: the copy that stays (the largest id of equal texts) and the size of its group.

    Texts are cut into content-defined chunks; a chunk's digest is its identifier after a check, over all distinct
    chunks, that no digest stands for two byte strings. Where one does, its chunks get the digest plus their SHA-256
    as identifier. Then texts are equal when their ordered lists of identifiers are: the chunks move through one
    shuffle, each once per task, and documents never do.

    A null text counts as empty. Of equal texts with the largest id several times, one row stays, the one read
    first. A null id comes after all others. An empty table gives no rows. Other columns are not read. Where
    ``row_col`` names a stored number of each row, ``row`` is that number.
    """
    recipes = cut_lineage(chunk_recipes(docs, id_col, text_col, digest_bytes, row_col))
    contents = distinct_chunks(docs, text_col, digest_bytes)
    doubtful = cut_lineage(contents.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest"))
    named = recipes.withColumn("names", F.col("recipe"))
    if not doubtful.isEmpty():
        # texts are read once more, so their numbers are stored with them
        read = numbered_texts(docs, id_col, text_col, row_col)
        recipes = cut_lineage(chunk_recipes(read, "doc_id", "text", digest_bytes, "row"))
        named = _rename(read, recipes, doubtful, digest_bytes)
    # the list's own hash makes a short join key; the list itself decides
    named = named.select("row", "doc_id", "text_sha256", "names", F.xxhash64("names").alias("h"))
    groups = named.groupBy("h", "names").agg(
        F.max(F.struct("doc_id", -F.col("row"))).alias("best"), F.count("*").alias("group_size")
    )
    # kept apart, so that the join has a shuffle of its own on either side and can split a hot group
    groups = cut_lineage(groups.filter("group_size > 1").withColumnsRenamed({"h": "g_h", "names": "g_names"}))
    same = (F.col("h") == F.col("g_h")) & (F.col("names") == F.col("g_names"))
    return named.join(groups, same, "left").select(
        "doc_id",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("best").isNull() | (-F.col("row") == F.col("best.col2"))).alias("kept"),
        "text_sha256",
        "row",
    )


def _rename(read, recipes, doubtful, digest_bytes):
    """Recipes in which each doubtful digest carries the SHA-256 of its chunk as well."""

    def cut(batches):
        for batch in slices(batches, 1):
            for row, chunks in zip(batch.column(0), _chunks(batch.column(1)), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row.as_py()] * len(chunks), pa.int64()),
                        pa.array(range(len(chunks)), pa.int32()),
                        pa.array([_digest(c, digest_bytes) for c in chunks], pa.binary()),
                        pa.array([hashlib.sha256(c).digest() for c in chunks], pa.binary()),
                    ],
                    ["row", "place", "digest", "sha"],
                )

    spots = read.select("row", "text").mapInArrow(cut, "row long, place int, digest binary, sha binary")
    marked = spots.join(doubtful.withColumn("double", F.lit(True)), "digest", "left")
    name = F.when(F.col("double"), F.concat("digest", "sha")).otherwise(F.col("digest"))
    lists = marked.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("place", name.alias("name")))).alias("l"))
    lists = lists.select("row", F.transform("l", lambda x: x["name"]).alias("names"))
    return recipes.join(lists, "row", "left").withColumn("names", F.coalesce("names", "recipe"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies that do not stay; all its columns."""
    numbered, row = with_row_number(docs)
    gone = exact_groups(numbered, id_col, text_col, row_col=row).filter(~F.col("kept")).select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").drop(row)
