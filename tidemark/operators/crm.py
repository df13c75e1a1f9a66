"""Creator tables: upserts, cascades, key allocation, boards and to-dos."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import meta as M
from tidemark.functions import talent as L
from tidemark.functions import text as T
from tidemark.operators.keyed import last_per_key, number_rows, replace_rows, top_k
from tidemark.session import cut_lineage

USER_FIELDS = ["id", "name", "style_prompt", "few_shot"]
PROFILE_TEXTS = ["name", "platform", "email", "recent_video_link", "notes", "collaboration_progress"]


def highest_id(table: DataFrame) -> int:
    """Largest id in use, 0 in an empty table."""
    return table.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).first()[0]


def in_id_order(table: DataFrame) -> DataFrame:
    return table.orderBy("id")


def append_scripts(scripts: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """New script rows with the next ids, in the order of a numeric column."""
    rows = number_rows(new, order, "id", highest_id(scripts))
    return rows.select(*scripts.columns) if set(scripts.columns) <= set(rows.columns) else rows


def style_profiles(requests: DataFrame, users: DataFrame) -> DataFrame:
    """Style prompt and examples of the requested user, defaults where there is none."""
    u = users.select(
        F.col("id").alias("user_id"),
        F.coalesce("style_prompt", F.lit("")).alias("_style"),
        F.coalesce("few_shot", F.lit("")).alias("_few"),
    )
    joined = requests.join(u, "user_id", "left")
    return joined.select(
        *requests.columns,
        F.coalesce("_style", F.lit(fixed.DEFAULT_STYLE)).alias("style_prompt"),
        F.coalesce("_few", F.lit("")).alias("few_shot"),
    )


def _new_users(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("user_id").alias("id"),
        "name",
        L.style_prompt(F.col("name"), F.coalesce("notes", F.lit(""))).alias("style_prompt"),
        F.lit("").alias("few_shot"),
    )


def link_users(profiles: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, users) after every profile without a user got one, ids in profile order."""
    orphans = profiles.filter(F.col("user_id").isNull()).drop("user_id")
    numbered = number_rows(orphans, "id", "user_id", highest_id(users)).select(*profiles.columns)
    linked = profiles.filter(F.col("user_id").isNotNull()).unionByName(numbered)
    return linked, users.select(*USER_FIELDS).unionByName(_new_users(numbered))


def backfill_profiles(profiles: DataFrame, users: DataFrame) -> DataFrame:
    """Profiles made from the users when the profile table is empty, else the profiles as they are."""
    name = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit(fixed.BACKFILL_NAME_PREFIX), F.col("id").cast("string")))
    made = users.select(
        "id",
        F.col("id").alias("user_id"),
        name.alias("name"),
        F.lit(fixed.PLATFORM_UNSET).alias("platform"),
        F.lit("").alias("email"),
        F.lit("").alias("recent_video_link"),
        T.default_if_blank("style_prompt", fixed.BACKFILL_NOTES).alias("notes"),
        F.lit(fixed.PROGRESS_UNSET).alias("collaboration_progress"),
    )
    # one row at most, so that the flag is a single value to broadcast
    some = profiles.select(F.lit(1).alias("_k")).limit(1)
    needed = made.withColumn("_k", F.lit(1)).join(F.broadcast(some), "_k", "left_anti").drop("_k")
    return profiles.unionByName(needed, allowMissingColumns=True)


def create_talents(
    profiles: DataFrame, users: DataFrame, new: DataFrame, order: str
) -> tuple[DataFrame, DataFrame]:
    """(profiles, users) with a profile and a user for every new row."""
    shaped = new.withColumns({c: T.strip(F.coalesce(c, F.lit(""))) for c in PROFILE_TEXTS}).withColumns(
        {
            "platform": T.default_if_blank("platform", fixed.PLATFORM_UNSET),
            "collaboration_progress": T.default_if_blank("collaboration_progress", fixed.PROGRESS_UNSET),
        }
    )
    last_profile, last_user = highest_id(profiles), highest_id(users)
    numbered = number_rows(shaped, order, "_no")
    rows = numbered.withColumns({"id": F.col("_no") + last_profile, "user_id": F.col("_no") + last_user})
    made = rows.select("id", "user_id", *PROFILE_TEXTS)
    return (
        profiles.unionByName(made, allowMissingColumns=True),
        users.select(*USER_FIELDS).unionByName(_new_users(made)),
    )


def update_talents(profiles: DataFrame, users: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(profiles, users) after changes (talent_id and the profile texts, one row per talent).

    The user of a changed profile takes its name and style; a profile whose user is
    missing gets a new one. Changes of unknown talents have no effect.
    """
    c = changes.select(F.col("talent_id").alias("id"), *PROFILE_TEXTS)
    known = users.select(F.col("id").alias("user_id"), F.col("few_shot").alias("_few"), F.lit(True).alias("_known"))
    hit = profiles.drop(*PROFILE_TEXTS).join(c, "id").join(known, "user_id", "left")
    lost = hit.filter(F.col("_known").isNull()).drop("user_id")
    renewed = number_rows(lost, "id", "user_id", highest_id(users)).select(*hit.columns)
    changed = hit.filter("_known").unionByName(renewed)
    rows = changed.select(*profiles.columns)
    touched = changed.select(
        F.col("user_id").alias("id"),
        "name",
        L.style_prompt(F.col("name"), F.col("notes")).alias("style_prompt"),
        F.coalesce("_few", F.lit("")).alias("few_shot"),
    )
    return replace_rows(profiles, rows, ["id"]), replace_rows(users.select(*USER_FIELDS), touched, ["id"])


def delete_talents(
    profiles: DataFrame, users: DataFrame, scripts: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(profiles, users, scripts) after deleting talents (id): users go too, scripts lose their user."""
    ids = deleted.select("id").distinct()
    gone = profiles.join(ids, "id", "left_semi").filter(F.col("user_id").isNotNull()).select("user_id").distinct()
    marked = scripts.join(gone.withColumn("_gone", F.lit(True)), "user_id", "left")
    freed = marked.withColumn("user_id", F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("user_id")))
    return (
        profiles.join(ids, "id", "left_anti"),
        users.join(gone.withColumnRenamed("user_id", "id"), "id", "left_anti"),
        freed.select(*scripts.columns),
    )


def stages(spark) -> DataFrame:
    """The fixed board columns (5 rows)."""
    rows = [(i, key, title) for i, (key, title, _) in enumerate(fixed.TALENT_STAGES, 1)]
    return spark.createDataFrame(rows, "stage_order int, stage string, title string")


def board(profiles: DataFrame) -> DataFrame:
    """Creators per stage, empty stages included."""
    counts = profiles.groupBy(L.stage("collaboration_progress").alias("stage")).agg(F.count("*").alias("talents"))
    return stages(profiles.sparkSession).join(counts, "stage", "left").withColumn(
        "talents", F.coalesce("talents", F.lit(0))
    )


def totals(profiles: DataFrame) -> DataFrame:
    """One row: creators, active creators and distinct platforms."""
    return profiles.agg(
        F.count("*").alias("talents"),
        F.count(F.when(L.is_active("collaboration_progress"), 1)).alias("active"),
        F.countDistinct(F.nullif(F.col("platform"), F.lit(""))).alias("platforms"),
    )


def todos(profiles: DataFrame) -> DataFrame:
    """The next step with every creator."""
    fields = ["name", "email", "recent_video_link", "notes", "collaboration_progress"]
    filled = profiles.withColumns({f: F.coalesce(f, F.lit("")) for f in fields})
    t = filled.withColumn("t", L.todo({f: F.col(f) for f in fields}))
    return t.select(
        F.col("id").alias("talent_id"),
        F.col("name").alias("talent_name"),
        F.col("t.priority").alias("priority"),
        F.col("t.text").alias("text"),
        L.priority_rank(F.col("t.priority")).alias("priority_order"),
    )


def todo_order(language: str = "zh") -> list[Column]:
    """Priority, then the name as readers of a language sort names (accents and case last), then the id."""
    return [F.col("priority_order"), F.collate("talent_name", language), F.col("talent_id")]


def top_todos(profiles: DataFrame, most: int = 10) -> DataFrame:
    """The most urgent steps, by priority and name."""
    return todos(profiles).orderBy(*todo_order()).limit(most)


def import_rows(base: DataFrame, rows: DataFrame, keys: list[str], defaults: dict[str, str]) -> DataFrame:
    """Merge by primary key; blank texts of the imported rows take their defaults."""
    filled = rows.withColumns(
        {c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(d)) for c, d in defaults.items() if c in rows.columns}
    )
    return replace_rows(base, filled, keys)


def _coerced(text: Column, kind: str, is_json: bool) -> tuple[Column, str]:
    """A text as a value of the column's type (null where it cannot be read), and what it should have been."""
    if is_json:
        return F.when(M.json_object_or_empty(text) == text, text), "no JSON object"
    if kind == "timestamp":
        return M.parse_time(text), "no time"
    if kind == "string":
        return text, ""
    return T.strip(text).try_cast(kind), f"no {kind}"


def import_typed(
    base: DataFrame,
    rows: DataFrame,
    keys: Sequence[str],
    order: str,
    defaults: dict[str, str] | None = None,
    json: Sequence[str] = (),
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(merged, problems): rows of texts merged into ``base`` by primary key, each column read by its type there.

    Of several rows of a key the last by ``order`` counts. A blank value takes the column's default, else null; a
    blank object is an empty one. A value that cannot be read counts as blank and is a problem: (row_no, column, value,
    reason). Rows whose key cannot be read are never merged; with ``strict`` no row with a problem is. ``rows`` may lack
    columns that are no keys: they become null, or their default.
    """
    defaults, kinds = defaults or {}, dict(base.dtypes)
    values, faults = {}, []
    for name, kind in kinds.items():
        if name not in rows.columns:
            values[name] = F.lit(defaults.get(name)).cast(kind)
            continue
        text = F.col(name).cast("string")
        # white space is a text
        blank = text.isNull() | ((text if kind == "string" and name not in json else T.strip(text)) == "")
        value, reason = _coerced(text, kind, name in json)
        wrong = ~blank & value.isNull() if reason else F.lit(False)
        if name in keys:
            wrong = wrong | blank
        missing = F.lit("{}") if name in json else F.lit(defaults.get(name)).cast(kind)
        values[name] = F.coalesce(F.when(~blank, value), missing)
        faults.append(F.when(wrong, F.struct(F.lit(name).alias("column"), text.alias("value"), F.lit(reason or "no key").alias("reason"))))
    found = F.filter(F.array(*faults), lambda x: x.isNotNull())
    read = rows.select(F.col(order).alias("_order"), *[v.alias(k) for k, v in values.items()], found.alias("_problems"))
    read = cut_lineage(read)
    problems = read.select(F.col("_order").alias("row_no"), F.explode("_problems").alias("p")).select("row_no", "p.*")
    no_key = F.exists("_problems", lambda p: p["column"].isin(*keys))
    good = read.filter(F.size("_problems") == 0 if strict else ~no_key)
    newest = last_per_key(good.drop("_problems"), keys, [F.col("_order")]).drop("_order")
    return replace_rows(base, newest.select(*kinds), keys), problems


def recent_todos_by(profiles: DataFrame, group: str, most: int = 10) -> DataFrame:
    """The most urgent steps per value of a profile column (say, per market)."""
    fields = profiles.select(F.col("id").alias("talent_id"), group)
    return top_k(todos(profiles).join(fields, "talent_id"), [group], todo_order(), most)
