"""Spelling variants: words one edit apart, found by pivotal grams."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

#: Maximal runs of these letters are words. The upper 64 and 26 lower-case ones make 8,100 bigrams at most.
RUNS = "([A-Za-zÀ-ÿ]+)"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Runs whose checksum this divides lose a letter.
MISTYPED = 199
LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
GRAM = 2
EDITS = 1


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mistyped: int = MISTYPED) -> DataFrame:
    """(word, n): words of all texts, some of them mistyped by a rule, with their occurrences."""
    read = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, UPPER.lower()).alias("text"),
    )
    # the outer form keeps Spark from evaluating the pattern once more in a filter on the list's size
    runs = read.select("id", F.explode_outer(F.regexp_extract_all("text", F.lit(RUNS), F.lit(1))).alias("run"))
    runs = runs.filter(F.length("run") >= LEAST_LENGTH)
    runs = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    short = F.expr("substring(run, 1, int(h % length(run))) || substring(run, int(h % length(run)) + 2)")
    word = F.when(F.col("h") % mistyped == 0, short).otherwise(F.col("run")) if mistyped else F.col("run")
    counts = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counts.filter((F.length("word") >= LEAST_LENGTH) & (F.col("n") >= LEAST_COUNT))


def gram_ranks(words: DataFrame) -> dict[str, int]:
    """Rank of each bigram, the rarest first; as many as pairs of letters at most."""
    spots = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(GRAM)))
    counts = words.select(F.explode_outer(spots).alias("gram")).groupBy("gram").count()
    rows = sorted((r["count"], r["gram"]) for r in counts.collect())
    return {gram: rank for rank, (_, gram) in enumerate(rows)}


def pick_pivots(spots: Sequence[tuple[int, int]], pivots: int = EDITS + 1) -> list[int]:
    """Positions of the disjoint grams, out of (position, rank), whose ranks have the least sum."""
    spots = sorted(spots)
    # best[k]: sum and positions of k disjoint grams among those seen that end before the next
    done: list[list[tuple[int, list[int]] | None]] = [[(0, []), *[None] * pivots]]
    for i, (at, rank) in enumerate(spots):
        # the last spot that does not overlap this one
        before = next((j for j in range(i, 0, -1) if spots[j - 1][0] + GRAM <= at), 0)
        row = list(done[i])
        for k in range(1, pivots + 1):
            base = done[before][k - 1]
            if base is not None:
                cand = (base[0] + rank, [*base[1], at])
                row[k] = cand if row[k] is None or cand < row[k] else row[k]
        done.append(row)
    return done[-1][pivots][1]


def prefix_of(word: str, ranks: dict[str, int]) -> tuple[list[tuple[int, int]], int]:
    """The rarest grams that EDITS edits cannot all destroy, with all their places, and the rank of the last."""
    spots = [(ranks[word[i : i + GRAM]], i) for i in range(len(word) - GRAM + 1)]
    last = sorted(spots)[GRAM * EDITS][0]
    return [(i, r) for r, i in spots if r <= last], last


def near_pairs(words: DataFrame, ranks: dict[str, int]) -> DataFrame:
    """Each pair (a, a_n, b, b_n) of words that one inserted, deleted or replaced letter tells apart, once.

    One edit destroys only one of a word's two disjoint pivots. It lies behind the first one, then all up to that
    pivot stands at the other word's start; or it does not, then all from the second one stands at its end. The
    surviving pivot is among the other word's prefix grams if that word's last prefix gram is not rarer. So the index
    holds pivots and prefix grams by place (the stretch from the word's start or to its end) and by the other word's
    length; what meets there is verified.
    """

    def entries(pivots: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys, sizes, names, counts, lasts, heads = [], [], [], [], [], []

                def put(key, size, word, n, last, head):
                    for column, value in zip((keys, sizes, names, counts, lasts, heads), (key, size, word, n, last, head), strict=True):
                        column.append(value)

                for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    spots, last = prefix_of(word, ranks)
                    if pivots:
                        first, second = pick_pivots(spots)
                        head = word[: first + GRAM]
                        for size in range(len(word) - EDITS, len(word) + EDITS + 1):
                            put("<" + head, size, word, n, last, head)
                            put(">" + word[second:], size, word, n, last, head)
                    else:
                        for at, _ in spots:
                            put("<" + word[: at + GRAM], len(word), word, n, last, "")
                            put(">" + word[at:], len(word), word, n, last, "")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.string()), pa.array(sizes, pa.int32()), pa.array(names, pa.string()),
                     pa.array(counts, pa.int64()), pa.array(lasts, pa.int32()), pa.array(heads, pa.string())],
                    ["key", "size", "word", "n", "last", "head"],
                )

        return words.select("word", "n").mapInArrow(run, "key string, size int, word string, n long, last int, head string")

    a = entries(True).withColumnsRenamed({"word": "a", "n": "a_n", "last": "a_last"})
    b = entries(False).drop("head").withColumnsRenamed({"word": "b", "n": "b_n", "last": "b_last"})
    met = a.join(b, ["key", "size"])
    # one way round, and by the first pivot where both find the pair
    order = (F.col("a_last") < F.col("b_last")) | ((F.col("a_last") == F.col("b_last")) & (F.col("a") < F.col("b")))
    once = F.col("key").startswith("<") | ~F.col("b").startswith(F.col("head"))
    return met.filter(order & once & (F.levenshtein("a", "b", EDITS) == EDITS)).select("a", "a_n", "b", "b_n")


def follow(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root) from (word, form): where following forms ends. Each round doubles the steps."""
    up = forms.select("word", F.col("form").alias("root"))
    for _ in range(rounds):
        more = up.select(F.col("word").alias("m_word"), F.col("root").alias("m_root"))
        up = up.join(more, F.col("root") == F.col("m_word"), "left")
        up = stored(up.select("word", F.coalesce("m_root", "root").alias("root")))
    return up


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mistyped: int = MISTYPED) -> DataFrame:
    """One row per word of six letters and five occurrences: the word it is taken for, and the end of that chain.

    A word's form is its near word of most occurrences (ties: the first in code-point order), if it has five times as
    many. As counts grow along a chain, it ends after as many steps as powers of five fit into the largest count.

    A null text has no words; a null id is written as nothing in the checksum of its runs. Repeated rows count as
    often as they stand there. An empty table, or one without words, gives no rows. Other columns are not read.
    """
    words = stored(count_words(docs, id_col, text_col, mistyped))
    ranks = gram_ranks(words)
    pairs = near_pairs(words, ranks)
    both = F.explode(
        F.array(
            F.struct(F.col("a").alias("w"), F.struct((-F.col("b_n")).alias("less"), F.col("b").alias("word")).alias("near")),
            F.struct(F.col("b").alias("w"), F.struct((-F.col("a_n")).alias("less"), F.col("a").alias("word")).alias("near")),
        )
    )
    near = pairs.select(both.alias("x")).groupBy(F.col("x.w").alias("w")).agg(F.count("*").alias("n_near"), F.min("x.near").alias("best"))
    joined = words.join(near, F.col("word") == F.col("w"), "left")
    taken = -F.col("best.less") >= RATIO * F.col("n")
    rows = stored(
        joined.select(
            "word",
            F.when(taken, F.col("best.word")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(taken, -F.col("best.less")).alias("form_n"),
        )
    )
    most = rows.agg(F.max("n")).first()[0] or 1
    steps = max(1, math.ceil(math.log(max(most / LEAST_COUNT, 1), RATIO)) + 1)
    forms = rows.filter("form is not null")
    roots = follow(forms, math.ceil(math.log2(steps))).withColumnRenamed("word", "r_word")
    out = rows.join(roots, F.col("word") == F.col("r_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
