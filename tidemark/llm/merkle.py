"""A Merkle manifest of a table: one tree per source, a tree over their roots, and proofs by multiproofs of leaf blocks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored
from tidemark.operators.keyed import number_rows

#: Children of a node.
FAN = 16
#: Levels that a leaf partition builds on its own: it holds FAN ** BLOCK_LEVELS consecutive leaves of a source.
BLOCK_LEVELS = 3
BLOCK = FAN**BLOCK_LEVELS
#: Leaves that a task expands, about.
TASK_LEAVES = 1 << 16
#: Columns whose values make a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Ids whose checksum this divides are tampered with.
TAMPER = 5

SCHEMA = (
    "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
    "source string, place long"
)


def digest(parts: Sequence[bytes]) -> bytes:
    """Hash of the parts in a row, as hex text."""
    return sha256(b"".join(parts)).hexdigest().encode()


def height(leaves: int) -> int:
    """Levels above the leaves of a tree."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // FAN), levels + 1
    return levels


def missing(known: Sequence[int], count: int) -> list[tuple[int, int]]:
    """The least set of nodes (level, index) that the paths of these leaves need and that do not follow from them.

    Siblings that are known or derived are left out, so leaves that lie together share what they fetch.
    """
    out, level, known = [], 0, set(known)
    while count > 1:
        parents = {i // FAN for i in known}
        for p in sorted(parents):
            out += [(level, i) for i in range(p * FAN, min(p * FAN + FAN, count)) if i not in known]
        known, count, level = parents, -(-count // FAN), level + 1
    return out


class Paths:
    """The part of a tree that some leaves and the missing nodes give: interiors are derived once, proofs read off."""

    def __init__(self, known: dict[int, bytes], count: int, fetched: dict[tuple[int, int], bytes]):
        self.levels: list[dict[int, bytes]] = []
        self.counts = [count]
        while count > 1:
            own = sorted({i // FAN for i in known})
            nodes = dict(known)
            level = len(self.levels)
            for p in own:
                for i in range(p * FAN, min(p * FAN + FAN, count)):
                    if i not in nodes:
                        nodes[i] = fetched[level, i]
            self.levels.append(nodes)
            count = -(-count // FAN)
            self.counts.append(count)
            known = {p: digest(self._run(level, p)) for p in own}
        (self.root,) = known.values()
        self._above: dict[tuple[int, int], bytes] = {}
        self._folds: dict[tuple[int, int, bytes], bytes] = {}

    def _run(self, level: int, parent: int) -> list[bytes]:
        return [self.levels[level][i] for i in range(parent * FAN, min(parent * FAN + FAN, self.counts[level]))]

    def siblings(self, level: int, index: int) -> bytes:
        """The siblings on the way up from a node, level by level."""
        if level == len(self.levels):
            return b""
        key = level, index
        if key not in self._above:
            run = self._run(level, index // FAN)
            del run[index % FAN]
            self._above[key] = b"".join(run) + self.siblings(level + 1, index // FAN)
            if not level:  # each leaf's own list is asked for once
                return self._above.pop(key)
        return self._above[key]

    def fold(self, level: int, index: int, node: bytes) -> bytes:
        """The root that follows from this node and the siblings on its way."""
        if level == len(self.levels):
            return node
        key = level, index, node
        if key not in self._folds:
            run = self._run(level, index // FAN)
            run[index % FAN] = node
            up = self.fold(level + 1, index // FAN, digest(run))
            if not level:
                return up
            self._folds[key] = up
        return self._folds[key]


def part(column: Column) -> Column:
    """A value as a leaf takes it: ``-`` or its byte count, a colon and itself."""
    text = column.cast("string")
    return F.when(column.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_of(columns: Sequence[Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*[part(c) for c in columns]), 256))


def _hash_run() -> Column:
    """Hash of up to FAN nodes of a group, by index."""
    run = F.sort_array(F.collect_list(F.struct("idx", "hash")))
    return F.unhex(F.sha2(F.array_join(F.transform(run, lambda x: F.lower(F.hex(x["hash"]))), ""), 256))


def _grow(nodes: DataFrame, most: int, level: int) -> DataFrame:
    """All levels of trees from one level's rows (tree, count of nodes at that level, idx, hash); as (.., level, ..)."""
    levels = [nodes.withColumn("level", F.lit(level))]
    while most > 1:
        # the children of one node are sixteen rows at most
        children = levels[-1].filter(F.col("count") > 1).withColumn("parent", F.expr(f"idx div {FAN}"))
        up = children.groupBy("tree", "count", "parent").agg(_hash_run().alias("hash"))
        level, most = level + 1, -(-most // FAN)
        levels.append(
            stored(
                up.select(
                    "tree",
                    F.ceil(F.col("count") / FAN).cast("long").alias("count"),
                    F.col("parent").alias("idx"),
                    "hash",
                    F.lit(level).alias("level"),
                )
            )
        )
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def leaves_in_place(leaves: DataFrame) -> DataFrame:
    """Adds to rows (src, doc_id, leaf, ..) their place in the source by (doc_id, leaf), and the source's size.

    Ranges of (src, doc_id, leaf) are sorted each on its own; a range starts after its source's rows in the ranges
    before. The ranges are stored, as another run would draw their cuts anew. Sums per source and range are as many
    as there are ranges and sources.
    """
    order = ["src", "doc_id", "leaf"]
    at = F.monotonically_increasing_id()
    placed = stored(leaves.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", at))
    placed = placed.withColumn("range", F.shiftright("at", 33))
    ranges = placed.groupBy("src", "range").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    sums = ranges.select(
        F.col("src").alias("r_src"),
        F.col("range").alias("r_range"),
        F.expr("first - coalesce(sum(n) over (partition by src order by range rows between unbounded preceding and 1 preceding), 0)").alias("zero"),
        F.expr("sum(n) over (partition by src)").alias("size"),
    )
    same = (F.col("src") == F.col("r_src")) & (F.col("range") == F.col("r_range"))
    joined = placed.join(stored(sums), same)
    return joined.select(*leaves.columns, (F.col("at") - F.col("zero")).alias("place"), "size")


def _block_roots(blocks: DataFrame) -> DataFrame:
    """The topmost node that each block derives alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                level = [h.hex().encode() for h in batch.column(3)[i].as_py()]
                size = batch.column(2)[i].as_py()
                for _ in range(min(BLOCK_LEVELS, height(size))):
                    level = [digest(level[k : k + FAN]) for k in range(0, len(level), FAN)]
                out.append(bytes.fromhex(level[0].decode()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["src", "block", "size", "hash"])

    hashes = F.transform("rows", lambda r: r["leaf"])
    return blocks.select("src", "block", "size", hashes.alias("h")).mapInArrow(run, "src string, block long, size long, hash binary")


def _wanted(blocks: DataFrame, sources: int) -> DataFrame:
    """The missing nodes of each block: of its source's tree, and of the tree over the sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for src, block, size, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = missing(range(block * BLOCK, min(block * BLOCK + BLOCK, size)), size)
                top = missing([pos], sources)
                n = len(own) + len(top)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([src] * n, pa.string()),
                        pa.array([block] * n, pa.int64()),
                        pa.array([f"s{src}"] * len(own) + ["t"] * len(top), pa.string()),
                        pa.array([x for x, _ in own + top], pa.int32()),
                        pa.array([x for _, x in own + top], pa.int64()),
                    ],
                    ["src", "block", "tree", "level", "idx"],
                )

    schema = "src string, block long, tree string, level int, idx long"
    return blocks.select("src", "block", "size", "pos").mapInArrow(run, schema)


def _expand(blocks: DataFrame, sources: int, root: str) -> DataFrame:
    """The proofs of each block's leaves, from its leaves and what it fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                src, block, size, pos, rows, got = (c[i].as_py() for c in batch.columns)
                got = got or []
                below = {(x["level"], x["idx"]): x["hash"].hex().encode() for x in got if x["tree"] != "t"}
                above = {(x["level"], x["idx"]): x["hash"].hex().encode() for x in got if x["tree"] == "t"}
                first = block * BLOCK
                leaves = [r["leaf"].hex().encode() for r in rows]
                tree = Paths(dict(enumerate(leaves, first)), size, below)
                top = Paths({pos: tree.root}, sources, above)
                rest = top.siblings(0, pos)
                proofs = [digest([tree.siblings(0, first + k), rest]).decode() for k in range(len(leaves))]
                ends: dict[bytes, str] = {}
                folded = []
                for k, r in enumerate(rows):
                    changed = r["changed"]
                    end = tree.fold(0, first + k, leaves[k] if changed is None else changed.hex().encode())
                    if end not in ends:
                        ends[end] = top.fold(0, pos, end).decode()
                    folded.append(ends[end])
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r["doc_id"] for r in rows], pa.int64()),
                        pa.array([x.decode() for x in leaves]),
                        pa.array([tree.root.decode()] * n),
                        pa.array([root] * n),
                        pa.array(proofs),
                        pa.array(folded),
                        pa.array([x == root for x in folded]),
                        pa.array([src[1:] if src[0] == "1" else None] * n, pa.string()),
                        pa.array(range(first, first + n), pa.int64()),
                    ],
                    ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "source", "place"],
                )

    return blocks.select("src", "block", "size", "pos", "rows", "got").mapInArrow(run, SCHEMA)


def prove_rows(docs: DataFrame, fields: Sequence[str] = FIELDS, tamper: int = TAMPER) -> DataFrame:
    """One row per row of ``docs``: its leaf, its source's root, the root of all, and the digest of its proof.

    ``fields`` names id, source, language, length and text. The leaves of a source, by id, make a tree of 16 children
    a node; the sources' roots, by source (null first), make the tree above. Leaves lie in blocks of 4,096 consecutive
    ones of a source. A block derives its own interiors, works out the least set of other nodes that its paths need,
    fetches them in one join and expands the proofs of its rows. A row whose id's checksum ``tamper`` divides is
    folded from the leaf of its lower-cased (A-Z) text; it fails unless the text has no such letter.

    Every value may be null. A null id comes first in its source and has the checksum of an empty text. Rows of equal
    id follow each other by leaf; repeated rows have a leaf each. An empty table gives no rows. Other columns are not
    read. No hot source is held by one task: ranges, blocks and the groups of levels above are bounded.
    """
    doc_id, source, lang, n_chars, text = (F.col(f) for f in fields)
    odd = F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(tamper)) == 0
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    lowered = F.translate(text, upper, upper.lower())
    leaves = docs.select(
        F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source.cast("string"))).alias("src"),
        doc_id.cast("long").alias("doc_id"),
        leaf_of([doc_id, source, lang, n_chars, text]).alias("leaf"),
        F.when(odd, leaf_of([doc_id, source, lang, n_chars, lowered])).alias("changed"),
    )
    leaves = stored(leaves)
    rows = leaves.count()
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // TASK_LEAVES)
    dealt = leaves_in_place(leaves).withColumn("block", F.expr(f"place div {BLOCK}")).repartition(tasks, "src", "block")
    # a block has BLOCK rows of some hundred bytes at most
    row = F.struct("place", "doc_id", "leaf", "changed")
    blocks = stored(dealt.groupBy("src", "block", "size").agg(F.sort_array(F.collect_list(row)).alias("rows")))
    nodes = stored(_block_roots(blocks))
    most = nodes.agg(F.max("size")).first()[0] or 0
    wide = F.col("size") > BLOCK
    low = nodes.filter(wide).select(
        F.concat(F.lit("s"), "src").alias("tree"),
        F.ceil(F.col("size") / BLOCK).cast("long").alias("count"),
        F.col("block").alias("idx"),
        "hash",
    )
    inner = _grow(low, -(-most // BLOCK), BLOCK_LEVELS)
    subroots = nodes.filter(~wide).select("src", "hash")
    subroots = subroots.unionByName(inner.filter("count = 1").select(F.expr("substr(tree, 2)").alias("src"), "hash"))
    subroots = stored(number_rows(subroots, "src", "pos", -1))
    sources = subroots.count()
    upper_nodes = _grow(
        subroots.select(F.lit("t").alias("tree"), F.lit(sources).cast("long").alias("count"), F.col("pos").alias("idx"), "hash"), sources, 0
    )
    end = upper_nodes.filter("count = 1").select(F.lower(F.hex("hash")).alias("h")).first()
    known = inner.unionByName(upper_nodes).select(F.col("tree").alias("t"), F.col("level").alias("l"), F.col("idx").alias("i"), "hash")
    placed = blocks.join(subroots.select(F.col("src").alias("s_src"), "pos"), F.col("src") == F.col("s_src")).drop("s_src")
    same = (F.col("tree") == F.col("t")) & (F.col("level") == F.col("l")) & (F.col("idx") == F.col("i"))
    got = _wanted(placed, sources).join(known, same)
    # fifteen nodes a level for each block
    got = got.groupBy(F.col("src").alias("g_src"), F.col("block").alias("g_block")).agg(
        F.collect_list(F.struct("tree", "level", "idx", "hash")).alias("got")
    )
    asked = placed.join(got, (F.col("src") == F.col("g_src")) & (F.col("block") == F.col("g_block")), "left")
    return _expand(asked.repartition(tasks, "src", "block"), sources, end.h if end else "")
