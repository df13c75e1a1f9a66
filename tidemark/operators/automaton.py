"""Large rule sets: one automaton over the rules' literals names the few patterns to run on a line.

A rule set is a table. Every match of a pattern contains one of a few literal stretches, which are worked out from the
parsed pattern; patterns without any are run on all lines. Each task builds one Aho-Corasick automaton over the
literals of a broadcast part of the rules, scans a script once, and runs a pattern only on lines where one of its
literals stands. The cost of a script follows its length and its hits, not the number of rules.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from re import _constants as sre
from re import _parser as parser

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import script as X
from tidemark.functions import text as T
from tidemark.operators import rules as R
from tidemark.operators.nearest import measured

#: Bytes of rules in one broadcast; a larger rule set takes several passes over the lines.
RULE_BYTES = 32 * 1024 * 1024
#: Literals that a rule may ask for instead of running everywhere.
MOST_LITERALS = 64
HIT = "rule_no int, family string, issue_type string, risk_level string, reason string, suggested_fix string, line string"

# letters that a case-insensitive pattern takes for ASCII ones
_ALIKE = str.maketrans("İıſK", "iisk")


def folded(text: str) -> str:
    """Lower case, character by character, with the letters that count as ASCII ones replaced."""
    return text.translate(_ALIKE).lower()


def _plain(code: int) -> str | None:
    """A character as the folded text has it, where no other character matches it."""
    c = chr(code)
    if c == "\n":
        return None
    if code < 128 or c in "İıſK":
        return folded(c)
    return c if c.lower() == c == c.upper() == c.casefold() else None


def literals(pattern: str) -> list[str]:
    """Folded stretches of which every match has one; empty where none is sure."""
    return sorted(_needed(parser.parse(pattern, re.IGNORECASE)) or ())


def _needed(sequence) -> set[str] | None:
    """The best set of a sequence: the one whose shortest literal is longest."""
    choices: list[set[str]] = []
    run = ""
    for op, value in [*sequence, (None, None)]:
        c = _plain(value) if op is sre.LITERAL else None
        if c is not None:
            run += c
            continue
        if run:
            choices.append({run})
            run = ""
        got = None
        if op is sre.SUBPATTERN and not value[1] and not value[2]:
            got = _needed(value[3])
        elif op is sre.ATOMIC_GROUP:
            got = _needed(value)
        elif op is sre.BRANCH:
            parts = [_needed(p) for p in value[1]]
            got = set().union(*parts) if all(parts) else None
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and value[0] > 0:
            got = _needed(value[2])
        if got and len(got) <= MOST_LITERALS:
            choices.append(got)
    return max(choices, key=lambda s: (min(map(len, s)), -len(s)), default=None)


class RuleAutomaton:
    """Rules (rule_no, family, pattern, issue_type, risk_level, reason, suggested_fix, products, literals)."""

    def __init__(self, rules: Sequence) -> None:
        self.rules = sorted(rules, key=lambda r: r["rule_no"])
        self.everywhere = [i for i, r in enumerate(self.rules) if not r["literals"]]
        self.products = [frozenset(r["products"] or ()) for r in self.rules]
        self.compiled: dict[int, re.Pattern] = {}
        self.runs = 0
        of_word = defaultdict(list)
        for i, r in enumerate(self.rules):
            for word in r["literals"] or ():
                of_word[word].append(i)
        self.machine = ahocorasick.Automaton()
        for word, rules_ in of_word.items():
            self.machine.add_word(word, rules_)
        if of_word:
            self.machine.make_automaton()

    def hits(self, lines: Sequence[str], product: str | None) -> list[tuple[int, str]]:
        """(place of the rule, its first matching line), in the order of the rules."""
        named: dict[int, set[int]] = defaultdict(set)
        if len(self.machine):
            ends, at = [], 0
            for line in lines:
                at += len(line) + 1
                ends.append(at)
            for end, rules in self.machine.iter(folded("\n".join(lines))):
                line_no = bisect.bisect_right(ends, end)
                for i in rules:
                    named[i].add(line_no)
        for i in self.everywhere:
            named[i] = set(range(len(lines)))
        out = []
        for i in sorted(named):
            if self.products[i] and product not in self.products[i]:
                continue
            if i not in self.compiled:
                self.compiled[i] = re.compile(self.rules[i]["pattern"], re.IGNORECASE)
            for n in sorted(named[i]):
                self.runs += 1
                if self.compiled[i].search(lines[n]):
                    out.append((i, lines[n]))
                    break
        return out


def with_literals(rules: DataFrame) -> DataFrame:
    """The rule table with the literals of each pattern."""
    find = F.pandas_udf(lambda patterns: pd.Series([literals(p) for p in patterns]), "array<string>")
    return rules.withColumn("literals", find("pattern"))


def _parts(rules: DataFrame, most_bytes: int) -> list[DataFrame]:
    """The rule table in parts of about ``most_bytes``."""
    text = ["pattern", "family", "issue_type", "risk_level", "reason", "suggested_fix"]
    each = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in text), F.lit(200)) + F.coalesce(F.octet_length(F.array_join("products", "")), F.lit(0))
    _, size = measured(rules, each)
    n = max(1, -(-size // most_bytes))
    return [rules.filter(F.pmod(F.xxhash64("rule_no"), F.lit(n)) == i) for i in range(n)] if n > 1 else [rules]


def rule_hits(lines: Column, product: Column, rules: DataFrame) -> Column:
    """Hits of one part of a rule table on an array of lines, as an array in the order of the rules."""
    held = rules.sparkSession.sparkContext.broadcast([r.asDict() for r in with_literals(rules).collect()])

    @F.pandas_udf(f"array<struct<{HIT.replace(' string', ': string').replace(' int', ': int')}>>")
    def find(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        automaton = RuleAutomaton(held.value)
        for texts, products in batches:
            out = []
            for own, p in zip(texts, products, strict=True):
                found = automaton.hits([] if own is None else list(own), p)
                out.append([_hit(automaton.rules[i], line) for i, line in found])
            yield pd.Series(out)

    return find(lines, product)


def _hit(rule: dict, line: str) -> dict:
    return {k: rule[k] for k in ("rule_no", "family", "issue_type", "risk_level", "reason", "suggested_fix")} | {"line": line}


def with_first_of_each(df: DataFrame, hits: str, name: str) -> DataFrame:
    """Adds ``name``: the hits without later ones of the same type and excerpt, found by sorting.

    The sorted places are a column of their own, so that they are not worked out per element.
    """
    placed = F.transform(F.col(hits), lambda x, i: F.struct(F.struct(x["issue_type"], x["excerpt"]).alias("key"), i.alias("i")))
    marked = df.withColumn("_marked", F.array_sort(placed))
    first = F.transform("_marked", lambda x, k: F.when((k == 0) | (x["key"] != F.get("_marked", F.greatest(k - 1, F.lit(0)))["key"]), x["i"]))
    marked = marked.withColumn("_first", F.array_sort(F.filter(first, lambda i: i.isNotNull())))
    return marked.withColumn(name, F.transform("_first", lambda i: F.get(hits, i))).drop("_marked", "_first")


def rule_issues(scripts: DataFrame, rules: DataFrame, script: str = "final_script", rule_bytes: int = RULE_BYTES) -> DataFrame:
    """Adds ``issues``, as :func:`tidemark.operators.rules.rule_issues` does, for a rule table of any size.

    ``rules`` has rule_no, family, pattern, issue_type, risk_level, reason, suggested_fix and products (none: all
    products). Issues are reported in the order of rule_no. A script stays one row.
    """
    body = F.coalesce(F.col(script), F.lit(""))
    mode, product = F.lower(F.col("distribution_mode")), F.lower(F.col("product_category"))
    platform = F.lower(F.col("target_platform"))
    undisclosed = F.coalesce(mode.isin(*fixed.DISCLOSURE_MODES) & R.lacks_disclosure(F.lower(body)), F.lit(False))
    staged = scripts.withColumns({"_lines": X.checkable_lines(body), "_u": undisclosed, "_product": product})
    parts = _parts(rules, rule_bytes)
    staged = staged.withColumns({f"_h{i}": rule_hits(F.col("_lines"), F.col("_product"), p) for i, p in enumerate(parts)})
    hits = F.array_sort(F.concat(*[F.col(f"_h{i}") for i in range(len(parts))]))
    risk = F.when(mode == "paid_ads", F.lit("high")).otherwise(F.lit("medium"))
    fix = T.lookup(platform, fixed.DISCLOSURE_FIXES, F.lit(fixed.DISCLOSURE_FIX_DEFAULT))
    disclosure = F.struct(
        F.lit(0).alias("rule_no"),
        F.lit("disclosure").alias("family"),
        F.lit("disclosure").alias("issue_type"),
        risk.alias("risk_level"),
        F.lit(fixed.DISCLOSURE_REASON).alias("reason"),
        fix.alias("suggested_fix"),
        F.coalesce(F.get("_lines", F.lit(0)), F.lit(fixed.DISCLOSURE_NO_LINE)).alias("line"),
    )
    staged = staged.withColumn("_found", F.concat(F.filter(F.array(disclosure), lambda _: F.col("_u")), hits))
    families = list(fixed.CITATION_PREFERENCES)
    cited = {f: R.pick_citations(F.col("evidence"), f) if "evidence" in scripts.columns else R.no_citations() for f in families}
    staged = staged.withColumns({f"_c_{f}": F.when(F.size("_found") > 0, v) for f, v in cited.items()})

    def full(x: Column) -> Column:
        cites = F.when(x["family"] == "disclosure", F.col("_c_disclosure")).when(x["family"] == "absolute", F.col("_c_absolute"))
        line = F.coalesce(F.nullif(x["line"], F.lit("")), F.lit("No exact excerpt available"))
        parts_ = [x["rule_no"], line, x["risk_level"], x["issue_type"], x["reason"], x["suggested_fix"], cites.otherwise(F.col("_c_sensitive"))]
        return F.struct(*[p.alias(n) for p, n in zip(parts_, ["rule_no", *R.ISSUE_FIELDS], strict=True)])

    done = staged.withColumn("_hits", F.transform("_found", full))
    spent = ["_lines", "_u", "_product", "_found", "_hits", *[f"_h{i}" for i in range(len(parts))], *[f"_c_{f}" for f in families]]
    return with_first_of_each(done, "_hits", "issues").drop(*spent)
