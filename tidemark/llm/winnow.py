"""Document fingerprints by winnowing, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Code points of a gram, and grams of a window. A shared passage of GRAM + WINDOW - 1 code points shares a hash.
GRAM = 16
WINDOW = 48
#: Windows that are looked at together, so that a very long text needs no more memory at a time than a short one.
BLOCK = 4096

#: A selected gram is (hash << 31) - (4 * position + 1), as one number: the least hash, then the rightmost place.
_LOW = 31
_HASH = ((1 << 32) - 1) << _LOW
_RUN = 64
#: The place of a null id, which comes before an equal one.
LEAST_ID = -(2**63)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, though it is used more often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _block_grams(block: Column, gram: int) -> Column:
    """All grams of a block of UTF-32 bytes, as numbers; a block shorter than a gram is one."""
    last = F.greatest(F.octet_length(block) - 4 * gram, F.lit(0)) + 1
    starts = F.sequence(F.lit(1), last, F.lit(4))
    return F.transform(
        starts,
        lambda i: F.shiftrightunsigned(F.xxhash64(F.substring(block, i, F.lit(4 * gram))), 1).bitwiseAND(F.lit(_HASH)) - i,
    )


def _place(gram: Column) -> Column:
    """1-based place of a packed gram among the grams of its block."""
    return F.shiftright((-gram).bitwiseAND(F.lit((1 << _LOW) - 1)) + 3, 2).cast("int")


def _winnow_block(block: Column, gram: int, window: int) -> Column:
    """Selected grams of a block: the rightmost least of each window, once, in their order.

    From one selected gram the next is the first lesser one that a sliding window meets, or, when the gram leaves the
    window before that, the least of the window behind it. So the work is a look at one window per selected gram.
    """

    def select(grams: Column) -> Column:
        def following(last: Column) -> Column:
            def choose(ahead: Column) -> Column:
                lesser = F.array_min(ahead) < last
                whole = _place(last) + window <= F.size(grams)
                return F.when(lesser, F.get(F.filter(ahead, lambda v: v < last), F.lit(0))).when(whole, F.array_min(ahead))

            return let(F.slice(grams, _place(last) + 1, F.lit(window)), choose)

        def state(last: Column, picked: Column) -> Column:
            return F.struct(last.alias("last"), picked.alias("picked"))

        def step(at: Column, _: Column) -> Column:
            moved = let(following(at["last"]), lambda v: F.when(v.isNull(), state(v, at["picked"])).otherwise(state(v, F.array_append(at["picked"], v))))
            return F.when(at["last"].isNull(), at).otherwise(moved)

        # as many steps as grams at most, in runs, so that a finished block skips what is left by runs
        run = F.sequence(F.lit(1), F.lit(_RUN))
        runs = F.sequence(F.lit(1), F.ceil(F.size(grams) / _RUN).cast("int"))
        first = let(F.array_min(F.slice(grams, 1, window)), lambda v: state(v, F.array(v)))
        done = F.aggregate(runs, first, lambda at, _: F.when(at["last"].isNull(), at).otherwise(F.aggregate(run, at, step)))
        return done["picked"]

    return let(_block_grams(block, gram), select)


def winnow(text: Column, gram: int = GRAM, window: int = WINDOW, block: int = BLOCK) -> Column:
    """Selected grams of a text in their order; none of an empty text.

    The text is taken as UTF-32, in which a gram of code points is a fixed run of bytes, and in blocks that overlap
    by a window and a gram, so that each window lies in one of them.
    """
    span = 4 * (block + window + gram - 2)

    def of(data: Column) -> Column:
        windows = F.octet_length(data) / 4 - (gram + window - 2)
        blocks = F.greatest(F.ceil(windows / block).cast("int"), F.lit(1))
        parts = F.transform(
            F.sequence(F.lit(0), blocks - 1),
            lambda i: F.transform(
                let(F.substring(data, i * (4 * block) + 1, F.lit(span)), lambda b: _winnow_block(b, gram, window)),
                lambda v: v - i * (4 * block),
            ),
        )
        return F.array_distinct(F.flatten(parts))

    none = F.array().cast("array<bigint>")
    return F.when(F.length(text) == 0, none).otherwise(let(F.encode(text, "UTF-32"), of))


def position(selected: Column) -> Column:
    """Place of a selected gram in code points."""
    return F.shiftright((-selected).bitwiseAND(F.lit((1 << _LOW) - 1)), 2)


def gram_hash(selected: Column) -> Column:
    """The 32-bit hash of a selected gram."""
    return F.shiftright(selected + F.lit((1 << _LOW) - 1), _LOW)


def written(selection: Column) -> Column:
    """A fingerprint as text: ``hash@position``, in the order of the positions."""
    return F.array_join(F.transform(selection, lambda v: F.concat(F.hex(gram_hash(v)), F.lit("@"), position(v))), " ")


def hash_set(selection: Column) -> Column:
    return F.array_distinct(F.transform(selection, gram_hash))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, F.lit(1.0)).otherwise(both / all_)


def winnow_edited(
    selection: Column, edited: Column, same: Column, gram: int = GRAM, window: int = WINDOW, block: int = BLOCK
) -> Column:
    """Selected grams of an edited text whose first ``same`` code points are those of a text winnowed before.

    A gram whose windows all lie in the common part is selected in both; only the rest is winnowed again.
    """
    # the first place with a window that reaches beyond the common part, and a place before all windows that hold it
    changed = F.greatest(same - (gram + window - 2), F.lit(0))
    start = F.greatest(changed - window, F.lit(0))
    kept = F.filter(selection, lambda v: position(v) < changed)
    again = winnow(F.substring(edited, start + 1, F.length(edited)), gram, window, block)
    moved = F.filter(F.transform(again, lambda v: v - start * 4), lambda v: position(v) >= changed)
    return F.concat(kept, moved)


def slice_of(key: Column, cuts: list[int]) -> Column:
    """Number of cuts at or below the key, over a sorted list: first among every n-th, then among the next n."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    literal = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    coarse = cuts[step - 1 :: step]
    whole = below(literal(coarse)) * step if coarse else F.lit(0)
    return whole + below(F.slice(literal(cuts), whole + 1, F.lit(step)))


def with_next(
    rows: DataFrame, key: str, carried: list[str], prepared: Callable[[DataFrame], DataFrame], slices: int, ties: list[str]
) -> DataFrame:
    """Each row with ``next``, the ``carried`` columns of the row that follows by ``key``; the last is followed by the first.

    Rows of one key follow each other by ``ties``.

    Sampled keys cut the order into slices; the row at a cut goes to the slice before as well. So a slice finds all
    followers within itself, and the order never meets in one task. ``prepared`` adds columns behind the shuffle.
    """
    near = rows.agg(
        F.percentile_approx(key, [i / slices for i in range(1, slices)] or [0.5], max(10_000, 20 * slices))
    ).first()[0]
    # the sample rounds large keys, so the least key of each slice is the cut: never more than there are slices
    found = rows.groupBy(slice_of(F.col(key), sorted(set(near or []))).alias("s")).agg(F.min(key).alias("least"))
    first, *cuts = sorted(r.least for r in found.collect()) or [0]
    own = slice_of(F.col(key), cuts)
    ghost = F.struct((own - 1).alias("slice"), F.lit(1).alias("ghost"), F.lit(0).alias("wrap"))
    is_cut = F.lit(False)
    if cuts:
        is_cut = F.col(key).isin(cuts)
    wrap = F.struct(F.lit(len(cuts)).alias("slice"), F.lit(1).alias("ghost"), F.lit(1).alias("wrap"))
    real = F.struct(own.alias("slice"), F.lit(0).alias("ghost"), F.lit(0).alias("wrap"))
    places = F.concat(
        F.array(real),
        F.when(is_cut, F.array(ghost)).otherwise(F.array().cast("array<struct<slice:int,ghost:int,wrap:int>>")),
        F.when(F.col(key) == F.lit(first), F.array(wrap)).otherwise(
            F.array().cast("array<struct<slice:int,ghost:int,wrap:int>>")
        ),
    )
    dealt = rows.withColumn("_at", F.explode(places)).select("*", "_at.*").drop("_at").repartition("slice")
    order = Window.partitionBy("slice").orderBy("wrap", key, *ties)
    led = prepared(dealt).withColumn("next", F.lead(F.struct(*carried)).over(order))
    return led.filter("ghost = 0").drop("slice", "ghost", "wrap")


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", gram: int = GRAM, window: int = WINDOW, block: int = BLOCK
) -> DataFrame:
    """One row per row of ``docs``: its fingerprint, that of its edited text, and how like its own others are.

    The edited text has the last quarter of the code points replaced by as many first ones (or all) of the next
    document by id; the last document is followed by the first. Of equal ids that with the lesser text comes first; a
    null id comes before all others.

    A null text counts as empty and has an empty fingerprint; a text shorter than a gram is one gram, one with fewer
    grams than a window is one window. A single document follows itself. An empty table gives no rows. Other
    columns are not read.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("key"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    slices = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    paired = with_next(
        rows, "key", ["text", "own"], lambda d: d.withColumn("own", winnow(F.col("text"), gram, window, block)), slices,
        ["doc_id", "text"],
    )
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = paired.withColumn("same", n - cut).withColumn(
        "edited", F.concat(F.substring("text", F.lit(1), F.col("same")), F.substring("next.text", F.lit(1), cut))
    )
    both = edited.withColumn("edited_own", winnow_edited(F.col("own"), F.col("edited"), F.col("same"), gram, window, block))
    # the sets are columns of their own, evaluated once
    sets = both.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        "own",
        "edited_own",
        hash_set(F.col("own")).alias("a"),
        hash_set(F.col("edited_own")).alias("b"),
        hash_set(F.col("next.own")).alias("c"),
    )
    return sets.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        written(F.col("own")).alias("fingerprint"),
        written(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"),
        likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
