"""Finding and masking values by candidates and gaps; all in Spark's own expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions.detectors import CREDENTIALS, RULES, Rule, conditions
from ..functions.dialect import Spark


#: Ten digits in close order, as all rules of numbers need.
TEN_DIGITS = "[0-9](?:[^0-9]{0,2}[0-9]){9}"


def may_hit(text: Column, rule: Rule) -> Column:
    """Whether a text can hold a candidate, by plain substrings where the rule has any: much cheaper than its pattern."""
    if rule.digits:
        return text.rlike(TEN_DIGITS)
    found = F.lit(not rule.markers and not rule.words)
    for m in rule.markers:
        found = found | F.contains(text, F.lit(m))
    for w in rule.words:
        found = found | F.contains(F.lower(text), F.lit(w))
    return found


def candidates(corpus: DataFrame, rule: Rule) -> DataFrame:
    """row_id, src, ord, whole, value, lft and rgt of each candidate; lft and rgt reach over one neighbour."""
    pattern = F.lit(rule.pattern)
    hit = corpus.where(may_hit(F.col("text"), rule) & F.col("text").rlike(rule.pattern))
    cut = hit.select("row_id", "src", F.regexp_extract_all("text", pattern, F.lit(0)).alias("vals"), F.split("text", rule.pattern, -1).alias("gaps"))
    each = cut.select("row_id", "src", "vals", "gaps", F.posexplode("vals").alias("i", "whole"))
    return each.select(
        "row_id",
        "src",
        F.col("i").cast("long").alias("ord"),
        "whole",
        (F.regexp_extract("whole", rule.pattern, rule.group) if rule.group else F.col("whole")).alias("value"),
        F.concat(F.coalesce(F.get("vals", F.col("i") - 1), F.lit("")), F.get("gaps", F.col("i"))).alias("lft"),
        F.concat(F.get("gaps", F.col("i") + 1), F.coalesce(F.get("vals", F.col("i") + 1), F.lit(""))).alias("rgt"),
    )


def find(corpus: DataFrame, rule: Rule) -> DataFrame:
    """row_id, src, ord, label and value of each value of ``corpus`` (row_id, src, text) that passes the rule.

    Null texts hold none; repeated rows give repeated results; other columns are ignored.
    """
    kept = candidates(corpus, rule).where(F.expr(conditions(rule, Spark)))
    return kept.select("row_id", "src", "ord", F.lit(rule.label).alias("label"), "value")


def find_all(corpus: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Values of all rules, each on the text as it is: the scan of responses, where rules don't rewrite.

    One scan for all rules: each cuts the text of a row where its pattern matches at all; the candidates of
    all rules are exploded once and meet the condition of their rule. Columns as of ``find``, and rule.
    """
    rules = rules if rules is not None else [r for r in RULES if r.on]
    none = F.array().cast("array<string>")
    seen = corpus.select("row_id", "src", "text", F.col("text").rlike(TEN_DIGITS).alias("ten"))
    may = lambda r: F.col("ten") if r.digits else may_hit(F.col("text"), r)
    hit = F.lit(False)
    for r in rules:
        hit = hit | may(r)
    cut = seen.where(hit).select("row_id", "src", "text", *[F.when(may(r), F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))).otherwise(none).alias(f"v{k}") for k, r in enumerate(rules)])
    cut = cut.select("row_id", "src", *[f"v{k}" for k in range(len(rules))], *[F.when(F.size(f"v{k}") > 0, F.split("text", r.pattern, -1)).otherwise(none).alias(f"g{k}") for k, r in enumerate(rules)])

    def candidates_of(k: int, r: Rule):
        v, g = F.col(f"v{k}"), F.col(f"g{k}")
        return F.transform(
            v,
            lambda w, i: F.struct(
                F.lit(r.key).alias("rule"),
                F.lit(r.label).alias("label"),
                i.cast("long").alias("ord"),
                w.alias("whole"),
                (F.regexp_extract(w, r.pattern, r.group) if r.group else w).alias("value"),
                F.concat(F.coalesce(F.get(v, i - 1), F.lit("")), F.get(g, i)).alias("lft"),
                F.concat(F.get(g, i + 1), F.coalesce(F.get(v, i + 1), F.lit(""))).alias("rgt"),
            ),
        )

    each = cut.select("row_id", "src", F.explode(F.concat(*[candidates_of(k, r) for k, r in enumerate(rules)])).alias("c")).select("row_id", "src", "c.*")
    kept = F.expr("CASE rule " + " ".join(f"WHEN '{r.key}' THEN {conditions(r, Spark)}" for r in rules) + " END")
    return each.where(kept).select("row_id", "src", "ord", "label", "value", "rule")


def redact(text, rules: list[Rule] | None = None):
    """Column with the whole match of every credential rule replaced, without checks: for logs, where excess does no harm.

    Only the prefix rule keeps its checks, as without them parts of plain identifiers would go; it comes last.
    """
    rules = rules or [r for r in RULES if r.label in CREDENTIALS]
    steps = [(r, r.pattern) for r in rules if r.key != "det00_prefix_key"] + [(r, PREFIXED) for r in rules if r.key == "det00_prefix_key"]

    def cleaned(step: tuple[Rule, str]):
        rule, pattern = step
        return lambda t: F.when(may_hit(t, rule), F.regexp_replace(t, pattern, "[REDACTED]")).otherwise(t)

    for step in steps:
        text = T.named(text, cleaned(step))
    return text


#: The prefix rule with its checks: the left neighbour, the security key's type, and a digit in short tails.
PREFIXED = r"(?<![A-Za-z0-9_-])(?:sk|ah)[-_](?=[A-Za-z0-9][A-Za-z0-9_-]{0,18}[0-9]|[0-9]|[A-Za-z0-9][A-Za-z0-9_-]{19})[A-Za-z0-9][A-Za-z0-9_-]{7,}+(?!@openssh\.com)"
