"""Near-duplicate texts by the Jaccard similarity of their word n-gram sets, with MinHash banding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import gram_hashes, hash63, mix64, number_in_key, numbered_texts, slices, with_row_number, word_hashes, words_of
from tidemark.llm.graph import components
from tidemark.session import cut_lineage

GRAM = 5
SIMILARITY = 0.8
RECALL = 0.9995
MOST_HASHES = 128
#: Texts of one side of a block that is verified by one task; a longer text counts as one for each UNIT grams begun.
BLOCK = 256
UNIT = 2048
#: Bytes of gram sets that a task hands on at once.
BATCH_BYTES = 1 << 22


def bands_and_rows(similarity: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """Bands and rows per band: the most selective rows whose bands meet ``recall`` within ``most_hashes``.

    A pair at the similarity s meets in one of b bands of r rows with probability 1 - (1 - s ** r) ** b.
    """
    best = None
    for rows in range(1, most_hashes + 1):
        bands = max(1, math.ceil(math.log(1 - recall) / math.log1p(-(similarity**rows)))) if similarity < 1 else 1
        if bands * rows <= most_hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding meets this recall with so few hashes")
    return best


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each text: (all, offsets).

    A text of fewer than n words has one gram, all its words; a text without words has none.
    """
    codes, offsets, words = words_of(texts)
    hashes = word_hashes(words)[codes]
    grams = gram_hashes(hashes, n)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if b - a >= n:
            out.append(np.unique(grams[a : b - n + 1]))
        elif b > a:
            out.append(gram_hashes(hashes[a:b], b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    ends = np.concatenate([[0], np.cumsum([len(x) for x in out], dtype=np.int64)])
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), ends


def minhash_bands(grams: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value per set and band; sets are not empty."""
    rng = np.random.default_rng(7)
    factors = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    out = np.empty((len(ends) - 1, bands), np.uint64)
    for band in range(bands):
        value = np.full(len(ends) - 1, band + 1, np.uint64)
        for i in range(band * rows, band * rows + rows):
            least = np.minimum.reduceat((grams ^ shifts[i]) * factors[i], ends[:-1])
            value = mix64(value * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, band] = value
    return out


def _signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """Per row: row number, id, a 128-bit digest and the size of its gram set, and its band values."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 2):
            grams, ends = gram_sets(part.column(2), n)
            sizes = np.diff(ends)
            full = np.flatnonzero(sizes)
            d1, d2 = np.zeros((2, len(sizes)), np.uint64)
            values: list = [None] * len(sizes)
            if len(full):
                starts = ends[:-1][full]
                d1[full] = np.add.reduceat(mix64(grams + np.uint64(1)), starts)
                d2[full] = np.bitwise_xor.reduceat(mix64(grams * np.uint64(0xD6E8FEB86659FD93)), starts)
                got = minhash_bands(grams, np.append(starts, len(grams)), bands, rows).view(np.int64)
                for i, row in zip(full.tolist(), got, strict=True):
                    values[i] = row
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(d1.view(np.int64)),
                    pa.array(d2.view(np.int64)),
                    pa.array(sizes.astype(np.int64)),
                    pa.array(values, pa.list_(pa.int64())),
                ],
                ["row", "doc_id", "d1", "d2", "n_grams", "bands"],
            )

    return docs.mapInArrow(sign, "row long, doc_id long, d1 long, d2 long, n_grams long, bands array<long>")


def links_within(left: list[np.ndarray], right: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Which sets of ``left`` and ``right`` (or of ``left`` among themselves) are similar enough."""
    sets = left + (right or [])
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    rank = np.cumsum(shared) - 1
    use = shared[codes]
    owner, codes = owner[use], rank[codes[use]]
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    n, m = len(left), len(right) if right is not None else len(left)
    inter = np.zeros((n, m), np.int64)
    width = 4096
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(codes, [start, start + width])
        matrix = np.zeros((len(sets), width), np.float32)
        matrix[owner[a:b], codes[a:b] - start] = 1
        inter += (matrix[:n] @ (matrix[n:] if right is not None else matrix).T).astype(np.int64)
    sizes_r = sizes[n:] if right is not None else sizes
    union = sizes[:n, None] + sizes_r[None, :] - inter
    linked = inter >= similarity * union - 1e-9
    if right is None:
        np.fill_diagonal(linked, False)
    return linked


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(node, root) for all nodes of a symmetric link matrix that are not their own root; roots come first."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] >= 0:
            continue
        root[start], todo = start, [start]
        while todo:
            for other in np.flatnonzero(linked[todo.pop()] & (root < 0)).tolist():
                root[other] = start
                todo.append(other)
    return [(i, int(r)) for i, r in enumerate(root.tolist()) if r != i]


def first_shared(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The first band in which two texts agree, for each of ``left`` and ``right``; the number of bands where in none."""
    out = np.full((len(left), len(right)), left.shape[1])
    for band in range(left.shape[1] - 1, -1, -1):
        out[left[:, band, None] == right[None, :, band]] = band
    return out


def _verify(similarity: float):
    """Streams sorted blocks: link counts per text, and edges that connect the same texts as all links do.

    In the block of a bucket only pairs are looked at whose first common band this is, in that of a whole set
    (band -1) those with any common band.
    """

    def flush(band, sides):
        left, right = sides.get(0, []), sides.get(1)
        if 0 not in sides:
            return _links([])
        alone = right is None
        right = left if alone else right
        bands = [np.array([b for _, b, _ in side], np.int64) for side in (left, right)]
        met = first_shared(*bands)
        met = met < bands[0].shape[1] if band < 0 else met == band
        if alone:
            np.fill_diagonal(met, False)
        use_l, use_r = np.flatnonzero(met.any(1)), np.flatnonzero(met.any(0))
        if not len(use_l):
            return _links([])
        rows_l, rows_r = [left[i][0] for i in use_l], [right[i][0] for i in use_r]
        sets_l = [np.frombuffer(left[i][2], np.uint64) for i in use_l]
        if alone:
            # who meets whom is symmetric here, so both sides are the same texts
            linked = links_within(sets_l, None, similarity) & met[np.ix_(use_l, use_r)]
            rows, counts = rows_l, linked.sum(1).tolist()
        else:
            part = links_within(sets_l, [np.frombuffer(right[i][2], np.uint64) for i in use_r], similarity)
            part &= met[np.ix_(use_l, use_r)]
            rows, n = rows_l + rows_r, len(rows_l)
            counts = part.sum(1).tolist() + part.sum(0).tolist()
            linked = np.zeros((len(rows),) * 2, bool)
            linked[:n, n:], linked[n:, :n] = part, part.T
        out = [(u, None, n) for u, n in zip(rows, counts, strict=True) if n]
        return _links(out + [(rows[a], rows[b], 0) for a, b in _forest(linked)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sides = None, {}
        for batch in batches:
            got = [batch.column(i).to_pylist() for i in range(len(_BLOCKS))]
            for band, group, i, j, side, row, bands, grams in zip(*got, strict=True):
                if (band, group, i, j) != key:
                    if sides:
                        yield flush(key[0], sides)
                    key, sides = (band, group, i, j), {}
                sides.setdefault(side, []).append((row, bands, grams))
        if sides:
            yield flush(key[0], sides)

    return run


def _links(rows):
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], pa.int64()) for i in range(3)], ["u", "v", "n"])


def seats_of(signed: DataFrame, reps: DataFrame, block: int) -> DataFrame:
    """Where each text is verified: (row, bands, seats), a seat being (band, group, mine, blocks).

    Texts that share a band value are a bucket. A group is a bucket, verified for the pairs that meet first in its
    band; or, where that copies fewer texts, the whole set of texts that buckets connect, verified for all pairs that
    share a band (band -1): the variants of one text meet in nearly every band. Both ways look at the same pairs.
    ``blocks`` is the number of blocks of the group, ``mine`` the one the text lies in.
    """
    weight = F.least(F.lit(block), F.ceil(F.col("n_grams") / UNIT)).cast("long")
    alone = cut_lineage(signed.join(reps, "row", "left_semi").select("row", "bands", weight.alias("weight")))
    values = alone.select("row", "weight", F.posexplode("bands").alias("band", "value"))
    # kept apart, so that the joins have a shuffle of their own on either side and can split a hot bucket
    buckets = values.groupBy("value", "band").agg(
        F.min("row").alias("first"),
        F.count("*").alias("n"),
        F.sum("weight").alias("size"),
        F.bit_xor(F.xxhash64("row")).alias("x1"),
        F.bit_xor(F.xxhash64("row", F.lit(1))).alias("x2"),
    )
    buckets = cut_lineage(buckets.filter("n > 1"))
    met = values.join(buckets.select("value", "first"), "value")
    members = components(met.filter("row <> first").select(F.col("row").alias("u"), F.col("first").alias("v")))
    members = members.join(alone.select(F.col("row").alias("node"), "weight"), "node")
    members = cut_lineage(members.withColumnRenamed("node", "row"))

    # buckets of the same texts are one, that of their first band: no pair of theirs meets earlier
    buckets = buckets.groupBy("first", "n", "x1", "x2").agg(
        F.min(F.struct("band", "value")).alias("b"), F.first(F.ceil(F.col("size") / block)).alias("blocks"), F.first("size").alias("size")
    )
    buckets = buckets.join(members.select(F.col("row").alias("first"), "label"), "first").select("b.*", "size", "blocks", "label")
    buckets = cut_lineage(buckets)
    whole = members.groupBy("label").agg(F.sum("weight").alias("all")).withColumn("blocks", F.ceil(F.col("all") / block))
    ways = whole.join(buckets.groupBy("label").agg(F.sum(F.col("size") * F.col("blocks")).alias("apart")), "label")
    ways = cut_lineage(ways.select("label", "blocks", (F.col("all") * F.col("blocks") <= F.col("apart")).alias("together")))
    apart = buckets.join(ways.filter("not together").select("label"), "label", "left_semi").select("value", "blocks")
    seats = members.join(ways.filter("together"), "label").select("row", "weight", F.lit(-1).alias("band"), F.col("label").alias("group"), "blocks")
    seats = seats.unionByName(values.join(apart, "value").select("row", "weight", "band", F.col("value").alias("group"), "blocks"))
    seats = cut_lineage(seats.withColumn("blocks", F.col("blocks").cast("int")).withColumn("_order", hash63("row")))
    order = [F.col("_order"), F.col("row")]
    placed = number_in_key(seats, ["band", "group"], order, "place", seats.count(), weight=F.col("weight"))
    # a text lies in the block where it ends, so that no block before the last is empty
    placed = placed.withColumn("mine", F.floor((F.col("place") + F.col("weight") - 1) / block).cast("int"))
    placed = placed.groupBy("row").agg(F.collect_list(F.struct("band", "group", "mine", "blocks")).alias("seats"))
    return alone.select("row", "bands").join(placed, "row")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n: int = GRAM,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
    most_hashes: int = MOST_HASHES,
    block: int = BLOCK,
    row_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: its class, the set it shares, and how many other sets it is linked to.

    Texts with the same n-gram set are copies (``set_id``: their smallest id); one of them stands for all. Two sets
    that share a band value are candidates; each such pair is verified once on the full sets, in blocks of ``block``
    by ``block`` texts, fewer of long ones (see :func:`seats_of`), so that no task holds a whole group and no pair
    becomes a row. ``n_links`` is the number of other sets at or above ``similarity``, ``class_id`` the smallest id
    of all texts that are connected by links, ``copies`` the number of rows with the same set.

    Words are runs of anything but ASCII white space, unchanged. A text of fewer than n words has one gram, all its
    words. Null, empty and blank texts share the empty set, which has no links. Equal ids are rows of their own; a
    null id never names a class that has another. An empty table gives no rows. Other columns are not read.
    Rows are numbered and stored once, unless ``row_col`` names a stored number of each row; ``row`` is that number.
    """
    bands, rows = bands_and_rows(similarity, recall, most_hashes)
    read = numbered_texts(docs, id_col, text_col, row_col)
    signed = cut_lineage(_signatures(read, n, bands, rows))
    sets = signed.groupBy("d1", "d2", "n_grams").agg(
        F.min("row").alias("rep"), F.min("doc_id").alias("set_id"), F.count("*").alias("copies")
    )
    sets = cut_lineage(sets)
    seats = seats_of(signed, sets.select(F.col("rep").alias("row")), block)
    texts = read.select("row", "text").join(seats, "row")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            grams, ends = gram_sets(part.column(1), n)
            out, size = [], 0
            got = [part.column(i).to_pylist() for i in (0, 2, 3)]
            for k, (row, values, places) in enumerate(zip(*got, strict=True)):
                data = grams[ends[k] : ends[k + 1]].tobytes()
                for place in places:
                    mine = place["mine"]
                    for other in range(place["blocks"]):
                        i, j = min(mine, other), max(mine, other)
                        out.append((place["band"], place["group"], i, j, int(mine > other), row, values, data))
                        size += len(data) + 256
                        if size >= BATCH_BYTES:
                            yield _block_rows(out)
                            out, size = [], 0
            if out:
                yield _block_rows(out)

    keys = ["band", "group", "i", "j"]
    schema = "band int, group long, i int, j int, side int, row long, bands array<long>, grams binary"
    spread = texts.mapInArrow(fill, schema).repartition(*keys).sortWithinPartitions(*keys, "side")
    found = cut_lineage(spread.mapInArrow(_verify(similarity), "u long, v long, n long"))
    links = found.filter("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n_links"))
    joined = components(found.filter("v is not null").select("u", "v"))
    named = joined.withColumnsRenamed({"node": "rep", "label": "root"})
    reps = sets.join(links, "rep", "left").join(named, "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    reps = cut_lineage(reps)
    ids = cut_lineage(reps.groupBy("root").agg(F.min("set_id").alias("class_id")))
    reps = reps.join(ids, "root").select(
        F.col("d1").alias("s1"), F.col("d2").alias("s2"), F.col("n_grams").alias("s3"), "set_id", "copies", "n_links", "class_id", "root", "rep"
    )
    same = (F.col("d1") == F.col("s1")) & (F.col("d2") == F.col("s2")) & (F.col("n_grams") == F.col("s3"))
    return signed.drop("bands").join(reps, same).select(
        "doc_id",
        "class_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "set_id",
        "copies",
        "n_grams",
        "row",
        "root",
    )


_BLOCKS = {
    "band": pa.int32(),
    "group": pa.int64(),
    "i": pa.int32(),
    "j": pa.int32(),
    "side": pa.int32(),
    "row": pa.int64(),
    "bands": pa.list_(pa.int64()),
    "grams": pa.binary(),
}


def _block_rows(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_BLOCKS.values())], list(_BLOCKS))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, the one with the smallest id; all its columns."""
    numbered, row = with_row_number(docs)
    classes = near_duplicates(numbered, id_col, text_col, row_col=row, **options).select("row", "root", "doc_id")
    classes = cut_lineage(classes)
    first = cut_lineage(classes.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")))
    gone = classes.join(first, "root").filter("row <> first.row").select(F.col("row").alias(row))
    return numbered.join(gone, row, "left_anti").drop(row)
