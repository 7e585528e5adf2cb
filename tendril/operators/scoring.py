"""Guards, votes and scores of judged criteria, and the third filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import preview
from ..providers import Provider, complete
from .classify import Rubric, rubric

CANDIDATES, RETURNED, CITED = 10, 5, 5


def guarded(score: Column, verdict: Column, most: Column) -> Column:
    """0 without evidence, else the score within 0 and its maximum."""
    return F.when(verdict == "no_evidence", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(score, most)))


def vote(judgments: DataFrame, by: list[str]) -> DataFrame:
    """(by, earned, verdict, run): mean of the guarded scores of the runs, the verdict of more than half of them, and the
    first run that has it (or the first run). judgments: (by, run, verdict, score, max_score)."""
    rows = judgments.withColumn("score", guarded(F.col("score"), F.col("verdict"), F.col("max_score")))
    found = F.count(F.when(F.col("verdict") == "found", 1))
    verdict = F.when(found * 2 > F.count("*"), "found").otherwise("no_evidence")
    of = lambda v: F.min(F.when(F.col("verdict") == v, F.col("run")))
    run = F.coalesce(F.when(verdict == "found", of("found")).otherwise(of("no_evidence")), F.min("run"))
    return rows.groupBy(*by).agg(F.round(F.avg("score"), 6).alias("earned"), verdict.alias("verdict"), run.alias("run"), F.max("max_score").alias("max_score"))


def soft_score(criteria: DataFrame, by: list[str]) -> DataFrame:
    """(by, soft_score): earned points as a whole percentage of the maximum, half to even, 100 at most, 0 without a maximum."""
    most = F.sum("max_score")
    share = F.bround(F.round(F.sum("earned") / F.nullif(most, F.lit(0.0)) * 100, 6)).cast("int")
    return criteria.groupBy(*by).agg(F.least(F.coalesce(share, F.lit(0)), F.lit(100)).alias("soft_score"))


def rubric_text(chunks: DataFrame, template: str | None = None, patterns: Rubric | None = None, places: int = 256) -> DataFrame:
    """(notice_id, rubric, n_chunks): the rubric chunks of each notice in order, or the template. Parts of ``places`` places
    are put together by themselves, so that only a notice's parts meet in one task."""
    found = rubric(chunks, "content", patterns).where("is_eval_table").withColumn("part_no", F.floor(F.col("chunk_index") / places))
    parts = concat_chunks(found, ["notice_id", "part_no"])
    texts = F.transform(F.array_sort(F.collect_list(F.struct("part_no", "body"))), lambda x: x["body"])
    joined = parts.groupBy(F.col("notice_id").alias("_notice")).agg(F.array_join(texts, "\n\n").alias("body"), F.sum("n_chunks").alias("n_chunks"))
    notices = chunks.select("notice_id").distinct()
    rows = notices.join(joined, F.col("notice_id").eqNullSafe(F.col("_notice")), "left")
    return rows.select("notice_id", F.coalesce("body", F.lit(template)).alias("rubric"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))


def third_filter(scored: DataFrame, candidates: int = CANDIDATES, returned: int = RETURNED) -> DataFrame:
    """(set_id, notice_id, soft_score, note, rank) of the best notices of each set.

    scored: (set_id, notice_id, aggregate_score, soft_score, outcome, error). The ``candidates`` best by aggregate score
    are judged; an outcome ``app_error`` counts as score 0 with the error as note, any other error drops the notice; of the
    rest the ``returned`` best by soft score stay, equal ones in the order of the aggregate score.
    """
    by_set = lambda *order: F.row_number().over(Window.partitionBy("set_id").orderBy(*order))
    cut = scored.withColumn("place", by_set(F.desc("aggregate_score"), "notice_id")).where(F.col("place") <= candidates)
    cut = cut.where(F.col("outcome").isin("scored", "app_error"))
    failed = F.col("outcome") == "app_error"
    cut = cut.withColumns({"soft_score": F.when(failed, 0).otherwise(F.col("soft_score")), "note": F.when(failed, F.col("error"))})
    return cut.withColumn("rank", by_set(F.desc("soft_score"), "place")).where(F.col("rank") <= returned).select("set_id", "notice_id", "soft_score", "note", "rank")


def citation_guard(reasons: DataFrame, known: DataFrame, most: int = CITED) -> DataFrame:
    """The first reasons of each notice; a citation of what isn't there becomes an inference.

    reasons: (notice_id, pos, grounding, cited_source, cited_id, cited_field); known: (source, id).
    """
    keys = known.select(F.col("source").alias("cited_source"), F.col("id").alias("cited_id"), F.lit(True).alias("_there")).distinct()
    rows = reasons.withColumn("_n", F.row_number().over(Window.partitionBy("notice_id").orderBy("pos"))).where(F.col("_n") <= most)
    both = rows.join(keys, ["cited_source", "cited_id"], "left")
    fine = (F.col("grounding") != "cited") | F.col("_there").isNotNull()
    keep = lambda c, other: F.when(fine, F.col(c)).otherwise(other).alias(c)
    return both.select("notice_id", "pos", keep("grounding", F.lit("inferred")), keep("cited_source", F.lit("none")), keep("cited_id", F.lit(None)), keep("cited_field", F.lit(None)))


def with_note(weaknesses: Column, note: Column) -> Column:
    """A note stands in for weaknesses only where there are none."""
    return F.when((F.size(weaknesses) == 0) & note.isNotNull(), F.array(note)).otherwise(weaknesses)


def partner_route(weaknesses: DataFrame, partners: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, company_id, n_weak, partner_id, route): mail if the chosen partner has an address, else search.

    weaknesses: (company_id, reasons array, choice int, from 0); partners: (company_id, partner_id, email). The first
    three reasons count, then blanks are dropped; without any the route is search.
    """
    listed = partners.withColumn("choice", F.row_number().over(Window.partitionBy("company_id").orderBy("partner_id")) - 1)
    own = weaknesses.withColumn("n_weak", F.size(F.filter(F.slice("reasons", 1, 3), lambda r: F.trim(r) != "")))
    both = own.join(listed, ["company_id", "choice"], "left")
    mail = (F.col("n_weak") > 0) & F.coalesce(F.col("email") != "", F.lit(False))
    return both.select(*keep, "company_id", "n_weak", F.when(mail, F.col("partner_id")).alias("partner_id"), F.when(mail, "email").otherwise("search").alias("route"))


def concat_chunks(chunks: DataFrame, by: list[str], separator: str = "\n\n") -> DataFrame:
    """(by, body, n_chunks): the texts of each group in the order of chunk_index. A body is one value: where a group has no
    bound, group by parts of its places too."""
    rows = F.array_sort(F.collect_list(F.struct("chunk_index", "content")))
    return chunks.groupBy(*by).agg(F.array_join(F.transform(rows, lambda x: x["content"]), separator).alias("body"), F.count("*").alias("n_chunks"))


def notice_body(chunks: DataFrame, n: int = 6000) -> DataFrame:
    """(notice_id, body): all texts of a notice, cut; null if empty. Only texts that can reach the cut are gathered, and the
    places are counted from lengths alone."""
    order = Window.partitionBy("notice_id").orderBy("chunk_index")
    before = F.coalesce(F.sum(F.col("size") + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = chunks.select("notice_id", "chunk_index", F.length("content").alias("size"))
    # A text that starts just behind the cut brings the separator before it, which may lie inside.
    near = sizes.withColumn("before", before).where(F.col("before") < n + 2).select("notice_id", "chunk_index")
    texts = chunks.select("notice_id", "chunk_index", F.substring("content", 1, n).alias("content")).join(near, ["notice_id", "chunk_index"])
    notices = chunks.select("notice_id").distinct()
    return notices.join(concat_chunks(texts, ["notice_id"]), "notice_id", "left").select("notice_id", preview(F.col("body"), n).alias("body"))


def summary(bodies: DataFrame, provider: Provider, most: int = 100) -> DataFrame:
    """(notice_id, summary): what a model says of each body, cut; null where there is no body."""
    told = complete(bodies.where("body is not null"), provider, "body", "answer")
    return bodies.select("notice_id").join(told.select("notice_id", preview(F.col("answer"), most).alias("summary")), "notice_id", "left")


def criterion_prompt(criteria: DataFrame, ranked: DataFrame, projects: DataFrame, most_projects: int = 50) -> DataFrame:
    """(criterion_id, prompt): a criterion with its chunks and the company's projects.

    criteria: (criterion_id, company_id, name, description, max_score); ranked: (criterion_id, chunk_id, rank, content);
    projects: (company_id, project_id, title).
    """
    lines = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("line")))), lambda x: x["line"]), "\n")
    texts = ranked.groupBy("criterion_id").agg(lines(["rank"], F.concat(F.lit("- chunk_id="), "chunk_id", F.lit(": "), "content")).alias("chunks"))
    few = projects.withColumn("_n", F.row_number().over(Window.partitionBy("company_id").orderBy("project_id"))).where(F.col("_n") <= most_projects)
    listed = few.groupBy("company_id").agg(lines(["project_id"], F.concat(F.lit("- project_id="), "project_id", F.lit(" title="), "title")).alias("projects"))
    both = criteria.join(texts, "criterion_id", "left").join(listed, "company_id", "left")
    blank = F.lit("(none)")
    prompt = F.format_string("[criterion]\nname=%s\ndescription=%s\nmax_score=%s\n\n[chunks]\n%s\n\n[projects]\n%s", "name", "description", "max_score", F.coalesce("chunks", blank), F.coalesce("projects", blank))
    return both.select("criterion_id", prompt.alias("prompt"))
