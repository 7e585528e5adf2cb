"""Rule classifiers as column expressions: rubric tables, draft labels, review priority, final labels."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.text import matches, normalize

_U = "(?U)"


@dataclass(frozen=True)
class Rubric:
    """Patterns of the rubric detector."""

    vocabulary: Sequence[str] = T.RUBRIC_VOCABULARY
    keyword: str = T.RUBRIC_KEYWORD
    points: str = T.RUBRIC_POINTS
    total: str = T.RUBRIC_TOTAL
    grades: str = T.RUBRIC_GRADES
    level: str = T.RUBRIC_LEVEL
    requirements: Sequence[str] = T.RUBRIC_REQUIREMENTS
    header: str = T.RUBRIC_HEADER


def rubric(chunks: DataFrame, text: str = "content", patterns: Rubric | None = None) -> DataFrame:
    """Adds gate_a_hits, gate_b, disqualified, score and is_eval_table."""
    p = patterns or Rubric()
    t = F.col(text)
    has = lambda x: F.coalesce(t.rlike(_U + x), F.lit(False))
    number = lambda c: c.cast("int")
    table = has("<table[\\s>]") | has("(?dm)^\\s*\\|.*\\|\\s*$")
    keyword, total = has(p.keyword), has(p.total)
    found = chunks.select(
        "*",
        F.coalesce(F.regexp_count(t, F.lit(_U + p.points)), F.lit(0)).alias("_points"),
        table.alias("_table"),
        keyword.alias("_keyword"),
        total.alias("_total"),
        (table & ((F.size(F.array_distinct(F.regexp_extract_all(t, F.lit(f"({p.grades})"), 1))) >= 3) | has(p.level))).alias("_grade"),
        has(p.header).alias("_header"),
        sum((number(has(v)) for v in p.vocabulary), F.lit(0)).alias("gate_a_hits"),
    )
    by_table = F.col("_keyword") & (F.col("_table") | (F.col("_points") >= 4) | F.col("_total"))
    by_prose = (F.col("gate_a_hits") >= 3) & ((F.col("_points") >= 3) | F.col("_total") | F.col("_grade"))
    required = ~F.col("_keyword") & has("|".join(f"(?:{x})" for x in p.requirements))
    score = F.col("gate_a_hits") * 2 + 4 * number(F.col("_keyword")) + F.least("_points", F.lit(4)) + sum((w * number(F.col(c)) for c, w in (("_total", 2), ("_grade", 2), ("_header", 2), ("_table", 1))), F.lit(0)) - 8 * number(required)
    out = found.withColumns({"gate_b": by_table | by_prose, "disqualified": required, "score": score})
    out = out.withColumn("is_eval_table", (F.col("gate_a_hits") >= 1) & F.col("gate_b") & ~F.col("disqualified"))
    return out.drop("_points", "_table", "_keyword", "_total", "_grade", "_header")


@dataclass(frozen=True)
class DraftTerms:
    direct: Sequence[str] = T.DRAFT_DIRECT
    project: Sequence[str] = T.DRAFT_PROJECT
    generic: Sequence[str] = T.DRAFT_GENERIC


def draft_label(rows: DataFrame, text: str = "content", terms: DraftTerms | None = None) -> DataFrame:
    """Adds draft_grade, draft_confidence, draft_reason and draft_terms (array)."""
    terms = terms or DraftTerms()
    t = F.col("_text")
    found = rows.withColumn("_text", normalize(F.col(text))).select("*", matches(t, terms.direct).alias("_d"), matches(t, terms.project).alias("_p"), matches(t, terms.generic).alias("_g"))
    d, p, g = F.size("_d"), F.size("_p"), F.size("_g")
    both, some_d, two_p, some_p, some_g = (d >= 2) | ((d > 0) & (p > 0)), d > 0, p >= 2, p > 0, g > 0
    pick = lambda *xs: F.when(both, xs[0]).when(some_d, xs[1]).when(two_p, xs[2]).when(some_p, xs[3]).when(some_g, xs[4]).otherwise(xs[5])
    confidence = pick("high", "medium", "high", "medium", F.when(g >= 2, "medium").otherwise("low"), F.when(F.length(t) >= 80, "high").otherwise("medium"))
    out = found.select("*", pick(3, 3, 2, 2, 1, 0).alias("draft_grade"), confidence.alias("draft_confidence"), pick(*T.DRAFT_REASONS).alias("draft_reason"), F.array_distinct(F.concat("_d", "_p", "_g")).alias("draft_terms"))
    return out.drop("_text", "_d", "_p", "_g")


def review_priority(rows: DataFrame) -> DataFrame:
    """Adds priority and priority_reason, from draft_grade, draft_confidence, three ranks and notice_relevance."""
    best = F.least("dense_rank", "bm25_rank", "rrf_rank")
    high = F.col("draft_grade") >= 2
    clash = (F.col("notice_relevance") == 0) & high
    told = [F.when(c, F.lit(x)) for c, x in zip((high, best <= 10, clash), T.PRIORITY_REASONS, strict=True)]
    first = F.coalesce(high | (best <= 10) | clash, high)
    second = (F.col("draft_confidence") != "high") | (F.col("draft_grade") == 1) | F.coalesce(best <= 30, F.lit(False))
    name = F.when(first, "P0").when(second, "P1").otherwise("P2")
    reason = F.when(first, F.concat_ws(", ", *told)).when(second, T.PRIORITY_UNSURE).otherwise(T.PRIORITY_SURE)
    return rows.withColumns({"priority": name, "priority_reason": reason})


@dataclass(frozen=True)
class FinalTerms:
    direct: Sequence[str] = T.FINAL_DIRECT
    strong: Sequence[str] = T.FINAL_STRONG
    generic: Sequence[str] = T.FINAL_GENERIC
    procedural: Sequence[str] = T.FINAL_PROCEDURAL
    non_match: Sequence[str] = T.FINAL_NON_MATCH
    operation: Sequence[str] = T.FINAL_AI_OPERATION
    lists: Sequence[str] = T.FINAL_LISTS
    inventory: Sequence[str] = T.FINAL_INVENTORY
    scope: Sequence[str] = T.FINAL_SCOPE
    feature: Sequence[str] = T.FINAL_FEATURE
    adjacent: Sequence[str] = T.FINAL_ADJACENT
    integration: Sequence[str] = T.FINAL_INTEGRATION
    technical: Sequence[str] = T.FINAL_TECHNICAL
    details: Sequence[str] = T.FINAL_DETAILS
    requirement: str = T.FINAL_REQUIREMENT
    excluded: str = T.FINAL_EXCLUDED
    excluded_part: str = T.FINAL_EXCLUDED_PART
    overview: str = T.FINAL_OVERVIEW
    names: Sequence[str] = T.FINAL_NAMES
    reasons: Sequence[str] = field(default=T.FINAL_REASONS)


def final_decision(rows: DataFrame, text: str = "content", terms: FinalTerms | None = None) -> DataFrame:
    """Adds final_grade, final_rule (the number of the rule that decided), final_reason and final_notes."""
    k = terms or FinalTerms()
    t = F.col("_t")
    names = ("direct", "strong", "generic", "procedural", "non_match", "operation", "inventory", "scope", "feature", "adjacent", "integration", "technical")
    found = rows.withColumns({"_t": normalize(F.col(text)), "_g": F.coalesce(F.col("notice_relevance").cast("int"), F.lit(0)), "_topic": F.trim(F.coalesce("l_topic", F.lit("")))})
    found = found.select("*", *[matches(t, getattr(k, n)).alias(f"_{n}") for n in names])
    found = found.withColumn("_strong", F.when(F.contains(t, F.lit(k.excluded)), F.filter("_strong", lambda x: ~F.contains(x, F.lit(k.excluded_part)))).otherwise(F.col("_strong")))
    some = lambda n: F.size(f"_{n}") > 0
    any_of = lambda xs: F.size(matches(t, xs)) > 0
    detail = any_of(k.details)
    bare = F.length(F.trim(F.replace(t, F.lit("![image]"), F.lit(""))))
    listed = any_of(k.lists)
    low = (F.length(t) < 25) | F.when(listed, ~detail).otherwise(((F.length(t) < 80) & F.contains(t, F.lit(k.requirement)) & ~detail) | (bare < 25))
    up_to = lambda n: F.least("_g", F.lit(n))
    none = F.array().cast("array<string>")
    united = lambda *n: F.array_distinct(F.concat(*[f"_{x}" for x in n]))
    # (condition, grade, evidence), in the order of the rules.
    rules = [
        (F.col("_g") == 0, F.lit(0), none),
        (low, F.lit(0), none),
        (some("inventory"), F.when(some("direct") | some("strong") | some("generic"), up_to(1)).otherwise(0), F.col("_inventory")),
        (some("scope"), up_to(1), F.col("_scope")),
        (some("adjacent"), up_to(2), F.col("_adjacent")),
        (some("integration"), up_to(2), F.col("_integration")),
        (some("direct") & some("operation"), up_to(2), united("direct", "operation")),
        (some("direct") & (some("non_match") | some("procedural")), F.lit(0), F.col("_direct")),
        (some("direct"), up_to(3), F.col("_direct")),
        ((F.col("_topic") == k.overview) & (F.length(t) < 80) & any_of(k.names), up_to(1), none),
        (some("procedural") | some("non_match"), F.lit(0), united("procedural", "non_match")),
        (some("strong") & some("feature"), up_to(1), united("strong", "feature")),
        (some("strong"), up_to(2), F.col("_strong")),
        (some("generic"), up_to(1), F.col("_generic")),
        (some("technical"), up_to(1), F.col("_technical")),
        (F.lit(True), F.lit(0), none),
    ]
    rule = F.lit(None).cast("int")
    for n in range(len(rules) - 1, -1, -1):
        rule = F.when(rules[n][0], n).otherwise(rule)
    chosen = lambda place: F.element_at(F.array(*[r[place] for r in rules]), F.col("final_rule") + 1)
    out = found.withColumn("final_rule", rule)
    out = out.withColumns({"final_grade": chosen(1).cast("int"), "_evidence": chosen(2), "final_reason": F.element_at(F.array(*map(F.lit, k.reasons)), F.col("final_rule") + 1)})
    told = F.coalesce(F.nullif(F.array_join(F.slice("_evidence", 1, 6), " | "), F.lit("")), F.lit(T.FINAL_NO_EVIDENCE))
    out = out.withColumn("final_notes", F.concat(F.lit(T.FINAL_NOTE_START), "final_reason", F.lit(T.FINAL_NOTE_EVIDENCE), told))
    return out.drop("_t", "_g", "_topic", "_evidence", *[f"_{n}" for n in names])


def require_columns(rows: DataFrame, needed: set[str]) -> None:
    missing = sorted(needed - set(rows.columns))
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def finalize(rows: DataFrame) -> DataFrame:
    """Label rows with final_chunk_relevance and reviewer_notes filled in."""
    require_columns(rows, {"notice_relevance", "content", "final_chunk_relevance", "reviewer_notes"})
    if "l_topic" not in rows.columns:
        rows = rows.withColumn("l_topic", F.lit(None).cast("string"))
    found = final_decision(rows)
    done = {"final_chunk_relevance": F.col("final_grade").cast("string"), "reviewer_notes": F.col("final_notes")}
    return found.withColumns(done).drop("final_rule", "final_grade", "final_reason", "final_notes")


