"""Large rule sets by an automaton, against running every pattern on every line."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import script as X
from tidemark.operators import automaton as A
from tidemark.operators import rules as R
from tidemark.plans import inputs as I

FOLDER = "/root/testdata/sf0.001"
PATTERNS = [p for p, _ in fixed.ABSOLUTE_PATTERNS] + fixed.SENSITIVE_PATTERNS


@pytest.mark.parametrize(
    ("pattern", "want"),
    [
        (r"\b(best|no\.?1|#1)\b", ["#1", "best", "no"]),
        (r"risk[- ]freely", ["freely"]),
        (r"(?:ab|cd)+x*", ["ab", "cd"]),
        (r"a?b*c{0,2}", []),
        (r"\d+|x", []),
        (r".*", []),
        (r"é", []),
        (r"пример", []),
        (r"شفاء", ["شفاء"]),
        (r"Kilo", ["kilo"]),
        (r"(?i:Abc)d", ["d"]),
        (r"(x(y)z)", ["x"]),
        (r"a(?=b)cd", ["cd"]),
        (r"one\ntwo!", ["two!"]),
    ],
)
def test_literals(pattern, want):
    assert A.literals(pattern) == want


def test_every_match_holds_a_literal():
    words = ["best", "NO.1", "a#1 ", "100%x", "RİSK-free", "zero rıſk", "mıracle", "cura", "Anti-Aging", "anti âge", "heil", "weight loss", "يعالج", "ſafest", "K"]
    rng = random.Random(3)
    for pattern in [*PATTERNS, r"k+s", r"(s|st)op", r"[ab]c|de?f", r"x{2,3}y"]:
        found = A.literals(pattern)
        for _ in range(300):
            text = rng.choice(["", "x ", "xxY "]) + rng.choice(words) + rng.choice([" ", "sTOP", " DF", "ks"]) + rng.choice(words)
            if found and re.search(pattern, text, re.IGNORECASE):
                assert any(word in A.folded(text) for word in found)


def test_folding_keeps_places():
    text = "".join(chr(c) for c in range(0x20, 0x3000) if not 0xD800 <= c < 0xE000)
    assert len(A.folded(text)) == len(text)


def test_same_issues_as_one_column_per_rule(spark):
    scripts = I.scripts(spark, FOLDER)
    a, b = (
        sorted(map(tuple, R.issue_rows(x, "doc_id").drop("citations").collect()))
        for x in (R.rule_issues(scripts), A.rule_issues(scripts, R.rules_table(spark)))
    )
    assert a == b and len(a) > 300


def many_rules(n):
    """Rules over words of the texts and others, some gated by product, some without a literal."""
    rng = random.Random(1)
    stems = ["the", "ther", "tion", "ing", "ble", "con", "ent", "for", "and", "per"]
    out = []
    for i in range(1, n + 1):
        word = "".join(rng.choices(stems, k=rng.randint(2, 3)))
        pattern = rng.choice([rf"\b{word}\b", rf"{word}s?\b", rf"\b({word}|{word}al)\b", rf"{word}[a-f]", rf"\b{word} +\w+ing\b"])
        products = tuple(rng.sample(fixed.PRODUCT_CATEGORIES, 2)) if i % 5 == 0 else ()
        out.append(R.Rule(i, rng.choice(["absolute", "sensitive", "own"]), pattern, f"type{i % 7}", "medium", "r", "f", products))
    out[n // 2] = R.Rule(n // 2 + 1, "absolute", r"\b\d\d\d\b", "digits", "high", "r", "f", ())
    return out


@pytest.mark.parametrize("rule_bytes", [A.RULE_BYTES, 700_000])
def test_ten_thousand_rules(spark, rule_bytes):
    rules = many_rules(10_000)
    scripts = I.scripts(spark, FOLDER)
    got = {}
    for r in R.issue_rows(A.rule_issues(scripts, R.rules_table(spark, rules), rule_bytes=rule_bytes), "doc_id").collect():
        if r.rule_no:
            got.setdefault(r.doc_id, []).append((r.issue_no, r.rule_no, r.issue_type, r.excerpt))
    compiled = [(r, re.compile(r.pattern, re.IGNORECASE)) for r in rules]
    total = 0
    for row in scripts.select("doc_id", "product_category", X.checkable_lines("final_script").alias("lines")).collect()[::8]:
        # one search over all lines leaves out the rules that cannot match any of them
        joined = "\n".join(row.lines)
        want, seen = [], set()
        for rule, pattern in compiled:
            if (rule.products and row.product_category.lower() not in rule.products) or not pattern.search(joined):
                continue
            line = next((s for s in row.lines if pattern.search(s)), None)
            if line is not None and (rule.issue_type, line) not in seen:
                seen.add((rule.issue_type, line))
                want.append((rule.rule_no, rule.issue_type, line))
        assert [x[1:] for x in sorted(got.get(row.doc_id, []))] == want
        total += len(want)
    assert total > 20


def test_few_patterns_are_run():
    rules = [{"rule_no": r.rule_no, "pattern": r.pattern, "products": r.products, "literals": A.literals(r.pattern)} for r in many_rules(10_000)]
    automaton = A.RuleAutomaton(rules)
    lines = [f"line {i} of the thertion consing text" for i in range(200)]
    automaton.hits(lines, "beauty")
    assert automaton.runs < 10_000 * 200 / 100


def test_rules_of_any_product_and_empty_tables(spark):
    scripts = spark.createDataFrame(
        [(1, "#ad abc", "paid_ads", None, None), (2, None, "paid_ads", "beauty", "tiktok")],
        "doc_id int, final_script string, distribution_mode string, product_category string, target_platform string",
    )
    rules = [R.Rule(1, "own", "abc", "t", "low", "r", "f", ("beauty",)), R.Rule(2, "own", "ABC", "u", "low", "r", "f")]
    got = A.rule_issues(scripts, R.rules_table(spark, rules))
    assert [(r.doc_id, r.rule_no) for r in R.issue_rows(got, "doc_id").orderBy("doc_id").collect()] == [(1, 2), (2, 0)]
    none = R.rules_table(spark).filter(F.lit(False))
    assert [(r.doc_id, r.rule_no) for r in R.issue_rows(A.rule_issues(scripts, none), "doc_id").collect()] == [(2, 0)]
