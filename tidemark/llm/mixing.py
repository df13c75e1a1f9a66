"""Mixing sources to target weights by a subset-sum fit of each source's budget."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import hash63, number_in_key, with_row_number
from tidemark.session import cut_lineage

#: Weights by rank of the source, again and again.
WEIGHTS = (1, 2, 3)
#: Copies of a document at most.
MOST_COPIES = 3
#: Words that are fitted by the exact subset sum, at least and at most; in between twice the longest document that
#: fits, so that the greedy part before it leaves no more than this.
FIT_WORDS, MOST_FIT_WORDS = 1 << 16, 1 << 24
SEED = 20


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space; null and empty texts have none."""
    flat = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    # a word starts where a character that is not a blank follows a blank
    starts = F.regexp_count(F.concat(F.lit(" "), flat), F.lit(" [^ ]"))
    return starts.cast("long")


def water_fill(sources: DataFrame, most: int) -> DataFrame:
    """Adds ``target``: shares of all sizes by weight, none above ``most`` times its source's size.

    What a capped source cannot take is shared again among the others by weight, until none is above its cap. Each
    round is one aggregate of three numbers over the sources.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share = -1.0
    while True:
        cap = F.col("source_size") * most
        over = F.col("weight") * F.lit(share) > cap
        used, free = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col("weight")))).first()
        grown = (total - (used or 0)) / free if free else share
        if grown <= share:
            break
        share = grown
    return sources.withColumn("target", F.least(F.col("weight") * F.lit(max(share, 0.0)), cap.cast("double")))


def fit_budget(lengths: list[int], counts: list[int], budget: int, fit_words: int = FIT_WORDS) -> list[int]:
    """How many documents of each length to take so that their words come as near to ``budget`` as can be, not above.

    Each length first gives its even share, rounded down; then whole documents from the longest length down, both
    short of the budget by half of what is fitted; a bounded knapsack over the counts that are left fits the rest
    exactly, where the lengths allow it. ``fit_words`` grows to twice the longest document within the budget, up to
    MOST_FIT_WORDS. Beyond that, what is left can hold one more document, and the longest that fits goes in.
    """
    whole = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if whole <= budget:
        return list(counts)
    order = sorted((i for i in range(len(lengths)) if 0 < lengths[i] <= budget), key=lambda i: -lengths[i])
    longest = lengths[order[0]] if order else 0
    fit_words = max(fit_words, min(2 * longest, MOST_FIT_WORDS))
    even = max(0, budget - fit_words // 2)
    taken = [c * even // whole for c in counts]
    left = budget - sum(n * t for n, t in zip(lengths, taken, strict=True))
    for i in order:
        more = min(counts[i] - taken[i], max(0, left - fit_words // 2) // lengths[i])
        taken[i] += more
        left -= more * lengths[i]
    free = [i for i in order if taken[i] < counts[i] and lengths[i] <= left]
    if left > fit_words:
        # all that is left is longer than half of fit_words, so two of them do not fit
        for i in free[:1]:
            taken[i] += 1
        return taken
    # one bit per reachable sum, in units that all lengths are multiples of; a count goes in as powers of two and a
    # remainder; the first item that reaches a sum is remembered
    unit = math.gcd(*(lengths[i] for i in free)) or 1
    room, items = left // unit, []
    for i in free:
        rest, part = min(counts[i] - taken[i], left // lengths[i]), 1
        while rest > 0:
            items.append((i, min(part, rest)))
            rest, part = rest - part, part * 2
    reach, mask, first = 1, (1 << (room + 1)) - 1, np.full(room + 1, -1, np.int32)
    for k, (i, n) in enumerate(items):
        if reach >> room:
            break
        grown = (reach | reach << (n * lengths[i] // unit)) & mask
        new = np.frombuffer((grown ^ reach).to_bytes(room // 8 + 1, "little"), np.uint8)
        first[np.flatnonzero(np.unpackbits(new, bitorder="little"))] = k
        reach = grown
    at = reach.bit_length() - 1
    while at:
        i, n = items[first[at]]
        taken[i] += n
        at -= n * lengths[i] // unit
    return taken


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = SEED,
    size: Column | None = None,
    fit_words: int = FIT_WORDS,
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of ``docs``: its size, its source's size and target, the copies and the words that are taken.

    Sources in code point order, null last, weigh ``weights`` in turn. A target of e times the source and a part of
    it takes every document e times and a subset once more, whose size is fitted to that part: documents are counted
    by (source, length), a knapsack per source says how many of each length go in, and a seeded hash of the id says
    which. Only counts by length meet in one task; their number is bounded by the longest document.

    A null text has no words; documents without words are taken e times. Null is a source of its own. Equal ids with
    equal texts share their hash, and which of them goes in makes no difference. An empty table gives no rows.
    Other columns than these and ``carry`` are not read. The same rows give the same result, however they are laid
    out.
    """
    words = size if size is not None else word_count(F.col(text_col))
    rows = cut_lineage(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            words.cast("long").alias("size"),
            hash63(F.lit(seed), F.col(id_col).cast("long"), F.col(text_col)).alias("_order"),
            *carry,
        )
    )
    count = rows.count()
    lengths = cut_lineage(rows.groupBy("source", "size").agg(F.count("*").alias("n")))
    sizes = lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    sources = water_fill(_weighted(sizes, weights), most)
    plan = lengths.join(sources, lengths["source"].eqNullSafe(sources["source"])).select(
        lengths["source"], "size", "n", "source_size", "target"
    )

    def fit(table: pa.Table) -> pa.Table:
        part = table.to_pandas().sort_values("size")
        whole, target = int(part["source_size"].iloc[0]), float(part["target"].iloc[0])
        times = min(most, int(target // whole)) if whole else 0
        chosen = [0] * len(part)
        if whole and times < most:
            chosen = fit_budget(part["size"].tolist(), part["n"].tolist(), round(target) - times * whole, fit_words)
        out = pd.DataFrame({"s": table.column("source").to_pylist()[:1] * len(part), "z": part["size"].to_numpy()})
        out = out.assign(times=times, chosen=chosen, source_size=whole, target=target)
        return pa.Table.from_pandas(
            out,
            schema=pa.schema(
                [("s", pa.string()), ("z", pa.int64()), ("times", pa.int64()), ("chosen", pa.int64())]
                + [("source_size", pa.int64()), ("target", pa.float64())]
            ),
            preserve_index=False,
        )

    quota = plan.groupBy("source").applyInArrow(
        fit, "s string, z long, times long, chosen long, source_size long, target double"
    )
    quota = cut_lineage(quota)
    ranked = number_in_key(rows, ["source", "size"], [F.col("_order"), F.col("doc_id")], "_rank", count)
    mixed = ranked.join(quota, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    copies = F.col("times") + (F.col("_rank") < F.col("chosen")).cast("long")
    return mixed.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * copies).alias("taken"),
        copies.alias("copies"),
        "source",
        *carry,
    )


def _weighted(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Adds the weight of each source by its rank in code point order, null last."""
    # UTF-8 bytes sort as code points do
    ranges = sizes.repartitionByRange(F.col("source").asc_nulls_last())
    parts = cut_lineage(ranges.withColumn("_part", F.spark_partition_id()))
    counts = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    running = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(running), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(inside) - 1 + F.col("_before")
    turn = F.pmod(rank, F.lit(len(weights))).cast("int")
    ranked = parts.join(before, "_part").withColumn("_turn", turn)
    chosen = F.element_at(F.array(*[F.lit(w) for w in weights]), F.col("_turn") + 1)
    return cut_lineage(ranked.select("source", "source_size", chosen.alias("weight")))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; all its columns. Rows are numbered and stored once."""
    numbered, row = with_row_number(docs)
    quota = mix_sources(numbered, id_col, text_col, source_col, carry=(row,)).filter("copies > 0")
    # a place per copy is exploded behind the columns of the table, which keep their names
    taken, copies, each = (unused(numbered.columns, n) for n in ("_taken_row", "_taken_copies", "_taken_copy"))
    times = quota.select(F.col(row).alias(taken), F.col("copies").cast("int").alias(copies))
    joined = numbered.join(times, F.col(row) == F.col(taken))
    names = [F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*names, F.explode(F.sequence(F.lit(1), copies)).alias(each)).select(*names)


def unused(columns: list[str], name: str) -> str:
    """``name``, or a longer one that no column has."""
    while name.lower() in (c.lower() for c in columns):
        name += "_"
    return name
