"""Workflow events: labels, error classes and event-text decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import text as T


def step_error(step: Column, message: Column, assistant: str = "Assistant") -> Column:
    """(error type, message) shown for a failed step."""
    low = F.lower(F.coalesce(message, F.lit("")))
    kind = (
        F.when(step == "trend_hunter", F.lit("search_timeout"))
        .when(step.isin(*fixed.LLM_STEPS) & T.first_word_of(low, fixed.LLM_BUSY_WORDS), F.lit("llm_busy"))
        .when(step.isin(*fixed.COMPLIANCE_STEPS), F.lit("compliance_blocked"))
        .otherwise(F.lit("workflow_error"))
    )
    texts = {k: v.format(assistant=assistant) for k, v in fixed.STEP_ERRORS.items()}
    return F.struct(kind.alias("error_type"), T.lookup(kind, texts, F.lit("")).alias("message"))


def duration_label(ms: Column) -> Column:
    return (
        F.when(F.coalesce(ms, F.lit(0)) == 0, F.lit(""))
        .when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .otherwise(F.concat(T.to_fixed(ms / 1000, 1, ties_up=True), F.lit("s")))
    )


def step_order(steps: list[str]) -> dict[str, int]:
    return {name: i for i, name in enumerate(steps)}


def step_index(step: Column, steps: list[str]) -> Column:
    """Position of a step in the workflow, null for an unknown step."""
    out = F.lit(None).cast("int")
    for name, i in step_order(steps).items():
        out = F.when(step == name, F.lit(i)).otherwise(out)
    return out


def event_text(event: Column, payload: Column) -> Column:
    """One event in the text form of the event stream."""
    return F.concat(F.lit("event: "), event, F.lit("\ndata: "), payload, F.lit("\n\n"))


def decode_event(block: str | Column) -> Column:
    """(event, data) of one block of an event stream; data is null in a block without data lines."""
    lines = F.transform(F.split(T.col(block), "\n"), T.rstrip)
    names = F.filter(lines, lambda s: s.startswith("event:"))
    data = F.transform(
        F.filter(lines, lambda s: s.startswith("data:")), lambda s: T.lstrip(F.substr(s, F.lit(6)))
    )
    event = F.when(F.size(names) > 0, T.strip(F.substr(F.element_at(names, -1), F.lit(7)))).otherwise(F.lit("message"))
    return F.struct(
        event.alias("event"),
        F.when(F.size(data) > 0, F.array_join(data, "\n")).alias("data"),
    )


def is_terminal(event: Column) -> Column:
    return event.isin("complete", "error")


def citation_label(c: Column) -> Column:
    """Text of a citation."""
    def part(name: str, default: str) -> Column:
        return F.coalesce(F.nullif(c[name], F.lit("")), F.lit(default))

    return F.concat(
        F.coalesce(c["source_title"], F.lit("Untitled source")),
        F.lit(" · "),
        part("country_code", "GLOBAL"),
        F.lit(" · p."),
        part("page_num", "N/A"),
        F.lit(" · "),
        part("heading_path", "N/A"),
    )
