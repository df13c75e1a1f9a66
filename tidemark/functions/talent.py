"""Creator fields as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import text as T


def style_prompt(name: Column, notes: Column) -> Column:
    return T.default_if_blank(notes, T.fill(fixed.STYLE_PROMPT_TEMPLATE, name=name))


def stage(progress: str | Column) -> Column:
    """First stage one of whose words occurs in the progress text, else pending."""
    p = F.coalesce(T.col(progress), F.lit(""))
    out = F.when(F.lit(False), F.lit("pending"))
    for key, _, words in fixed.TALENT_STAGES:
        out = out.when(T.first_word_of(p, words), F.lit(key))
    return out.otherwise(F.lit("pending"))


def is_active(progress: str | Column) -> Column:
    return ~stage(progress).isin("pending", "done")


def progress_tone(progress: str | Column) -> Column:
    p = F.coalesce(T.col(progress), F.lit(""))
    return (
        F.when(T.first_word_of(p, fixed.TONE_LOW_WORDS), F.lit(fixed.TONE_LOW))
        .when(T.first_word_of(p, fixed.TONE_MEDIUM_WORDS), F.lit(fixed.TONE_MEDIUM))
        .otherwise(F.lit(fixed.TONE_MUTED))
    )


def todo(t: dict[str, Column]) -> Column:
    """(priority, text) of the next step with a creator."""
    s = stage(t["collaboration_progress"])
    out = None
    for key, field, blank_priority, blank_text, priority, text in fixed.TALENT_TODOS:
        filled = F.struct(F.lit(priority).alias("priority"), T.fill(text, name=t["name"]).alias("text"))
        value = filled
        if field is not None:
            blank = F.struct(F.lit(blank_priority).alias("priority"), T.fill(blank_text, name=t["name"]).alias("text"))
            value = F.when(T.is_blank(t[field]), blank).otherwise(filled)
        out = F.when(s == key, value) if out is None else out.when(s == key, value)
    return out


def priority_rank(priority: Column) -> Column:
    return F.when(priority == "high", 0).when(priority == "medium", 1).otherwise(2)
