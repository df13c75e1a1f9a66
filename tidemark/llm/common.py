"""Helpers that several operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import ensure_checkpoint_dir

#: Rows of one window group at least, on average, where rows of a key are numbered.
SLICE_ROWS = 256


def table(spark, folder: str, name: str) -> DataFrame:
    """A parquet table of a data folder; only Spark's reader touches the path."""
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: int, most_bytes: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Batches cut where their texts (column ``text``) pass ``most_bytes``; a longer text is alone.

    What a slice leaves free goes back to the system, as workers live on and serve other steps.
    """
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        upto, done = np.cumsum(sizes, dtype=np.int64), 0
        while done < batch.num_rows:
            before = upto[done - 1] if done else 0
            end = max(done + 1, int(np.searchsorted(upto, before + most_bytes, "right")))
            yield batch.slice(done, end - done)
            done = end
        pa.default_memory_pool().release_unused()


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a batch of texts: (code per word, offsets per text, distinct words).

    Null texts have no words.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    # white space at either end leaves an empty word there
    empty = pc.index(coded.dictionary, pa.scalar("", coded.dictionary.type)).as_py()
    if empty >= 0:
        real = codes != empty
        offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
    return codes, offsets, coded.dictionary


def word_hashes(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; seeds give hashes that have nothing to do with each other."""
    return np.fromiter(
        (xxhash.xxh3_64_intdigest(w, seed) for w in words.cast(pa.binary()).to_pylist()), dtype=np.uint64, count=len(words)
    )


def mix64(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (a multiply and shift finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive values; empty where there are fewer than k.

    Runs are built by doubling, so that the cost grows with log k.
    """
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    done, out, base, width = 0, None, hashes, 1
    while True:
        if k & width:
            part = base[done : done + n]
            out = part.copy() if out is None else mix64(out * np.uint64(0x9E3779B97F4A7C15) + part + np.uint64(done))
            done += width
        if done == k:
            return mix64(out + np.uint64(k))
        base = mix64(base[:-width] * np.uint64(0xD6E8FEB86659FD93) + base[width:])
        width *= 2


def number_in_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    rows: int,
    width: int = SLICE_ROWS,
    weight: Column | None = None,
) -> DataFrame:
    """Adds ``name``: 0-based, gapless position of each row in its key, by ``order``.

    With a ``weight``, the position is the sum of the weights of the rows before.

    ``order`` starts with a well spread 63-bit number (a hash). Its high bits cut a key into slices, which are
    numbered each on its own and shifted by the sizes of the slices before, so no task sees a whole key. ``rows``
    is the count of all rows. A key that held them all would get as many slices as rows in a slice, but no slices of
    less than ``width`` rows, so both steps share the work evenly.
    """
    bits = min(40, max(0, int(np.ceil(np.log2(max(1, rows / max(width, rows**0.5)))))))
    sliced = df.withColumn("_slice", F.shiftright(order[0], 63 - bits) if bits else F.lit(0).cast("long"))
    size = F.count("*") if weight is None else F.sum(weight)
    sizes = sliced.groupBy(*keys, "_slice").agg(size.alias("_n"))
    running = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    upto = F.row_number().over(inside) if weight is None else F.sum(weight).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ranked = sliced.withColumn("_inside", upto - (F.lit(1) if weight is None else weight))
    same = F.col("_slice") == F.col("_s")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = ranked.join(before, same).withColumn(name, F.col("_inside") + F.col("_before"))
    return out.select(*df.columns, F.col(name).cast("long").alias(name))


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as a table below the shared checkpoint folder and read again.

    Like a checkpoint it ends the lineage, but columns are compressed, which halves the disk that texts take.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def numbered_texts(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """Row number, id and text of each row: numbered and stored here, or with the stored numbers of ``row_col``."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    read = docs.select(row.alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return read if row_col else stored(read)


def with_row_number(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a number of each row, in a column whose name it does not have yet, as a stored table.

    The place of a row in a scan depends on how files are split, which may change between two scans, so numbers that
    rows are joined on are written once, with the rows.
    """
    name = "_row_number"
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return stored(df.withColumn(name, F.monotonically_increasing_id())), name


def hash63(*columns: Column | str) -> Column:
    """A well spread, non-negative 63-bit number of some columns."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)
