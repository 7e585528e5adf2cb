"""Texts for a model or a reader, put together from joined tables: fit prompts, company contexts, mail drafts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import compose

FIT_PROJECTS, CONTEXT_PROJECTS = 100, 20
# The words of the fit prompt and of the company context.
NO_PROFILE, NO_PROJECTS, NO_RECORD = "(등록된 프로필 없음)", "(등록된 프로젝트 없음)", "(등록된 실적 없음)"
MATCHED, NOTICE, CHUNKS, PROFILE = "2차필터 매칭", "[공고]", "공고 청크(2차 필터가 뽑은 상위 매칭 청크):", "[회사 프로필]"
PROJECTS = "[회사 프로젝트] (회사가 보유한 전체 실적 목록. 여기에 없는 실적은 회사에 없는 것이다)"
# The mail's subject and body, and the contact's name where none is given.
SUBJECT = "[협업 제안] 귀사와 {company_name}의 공동 캠페인 진행을 제안드립니다."
BODY = "안녕하세요, {partner_name}님, {company_name}의 {contact_name}입니다.\n이번에 좋은 기회로 협업을 제안드리고자 연락드렸습니다.\n\n저희 {company_name}은 최근 {project_title}를 진행하려고 합니다\n{help_needed}\n\n관련하여 보다 상세한 내용과 캠페인 기획안은 차후 다시 연락드리겠습니다."
CONTACT = "담당자"


def _lines(order: Sequence[str], line: Column, separator: str = "\n") -> Column:
    """The lines of a group in order; a group is bounded by the caller."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("line")))), lambda x: x["line"]), separator)


def _told(kind: str, key: str, fields: Sequence[str]) -> Column:
    """``kind#key: field=value, ...``; a value that isn't there is told as None."""
    parts = [F.concat(F.lit(f"{f}="), F.coalesce(F.col(f).cast("string"), F.lit("None"))) for f in fields]
    return F.concat(F.lit(f"{kind}#"), F.col(key).cast("string"), F.lit(": "), F.concat_ws(", ", *parts))


def first_of(rows: DataFrame, by: str, order: str, most: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return rows.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def fit_prompt(ranked: DataFrame, chunks: DataFrame, profiles: DataFrame, projects: DataFrame, profile_fields: Sequence[str], project_fields: Sequence[str], most_projects: int = FIT_PROJECTS) -> DataFrame:
    """(notice_id, company_id, prompt, profile_id, project_ids): what a model is asked about a notice and a company.

    ranked: (notice_id, company_id, chunk_id, rank, score, matched_source, matched_id), the few best of each notice; chunks:
    (chunk_id, content); profiles: (company_id, profile_id, fields), one a company; projects: (company_id, project_id,
    fields). Chunks without text are left out, and a notice without any other gets no row.
    """
    texts = ranked.join(chunks.where("content != ''").select("chunk_id", "content"), "chunk_id")
    line = F.format_string(f"- chunk_id=%s (rank=%s, score=%.4f, {MATCHED}=%s#%s)\n  %s", *[F.col(c).cast("string") for c in ("chunk_id", "rank")], F.col("score").cast("double"), F.col("matched_source"), F.col("matched_id").cast("string"), F.col("content"))
    asked = texts.groupBy("notice_id", "company_id").agg(_lines(["rank", "chunk_id"], line).alias("_chunks"))
    few = first_of(projects, "company_id", "project_id", most_projects)
    listed = few.groupBy("company_id").agg(_lines(["project_id"], _told("project", "project_id", project_fields)).alias("_projects"), F.array_sort(F.collect_list("project_id")).alias("project_ids"))
    own = profiles.select("company_id", "profile_id", _told("profile", "profile_id", profile_fields).alias("_profile"))
    both = asked.join(own, "company_id", "left").join(listed, "company_id", "left")
    prompt = F.concat(F.lit(f"{NOTICE} bid_notice_id="), F.col("notice_id").cast("string"), F.lit(f"\n{CHUNKS}\n"), F.col("_chunks"), F.lit(f"\n\n{PROFILE}\n"), F.coalesce("_profile", F.lit(NO_PROFILE)), F.lit(f"\n\n{PROJECTS}\n"), F.coalesce("_projects", F.lit(NO_PROJECTS)))
    return both.select("notice_id", "company_id", prompt.alias("prompt"), "profile_id", F.coalesce("project_ids", F.array().cast(listed.schema["project_ids"].dataType)).alias("project_ids"))


def company_context(companies: DataFrame, profiles: DataFrame, projects: DataFrame, profile_fields: Sequence[tuple[str, str]], project_fields: Sequence[tuple[str, str]], most: int = CONTEXT_PROJECTS) -> DataFrame:
    """(company_id, context): a company's profile and its first projects as ``label: value`` lines; fields: (label, column)."""
    text = lambda fields: compose([(name, F.col(c).cast("string")) for name, c in fields])
    own = profiles.select("company_id", text(profile_fields).alias("_profile"))
    few = first_of(projects, "company_id", "project_id", most)
    listed = few.groupBy("company_id").agg(_lines(["project_id"], text(project_fields)).alias("_projects"))
    both = companies.select("company_id").join(own, "company_id", "left").join(listed, "company_id", "left")
    return both.select("company_id", F.concat(F.coalesce("_profile", F.lit(NO_PROFILE)), F.lit("\n\n"), F.coalesce(F.nullif("_projects", F.lit("")), F.lit(NO_RECORD))).alias("context"))


def company_ready(companies: DataFrame, profiles: DataFrame, projects: DataFrame, profile_text: Column, project_text: Column) -> DataFrame:
    """(company_id, error): why a company's texts can't be embedded yet, null if they can: the first of ``no profile``,
    ``no project``, ``blank profile``, ``blank projects``."""
    own = profiles.groupBy("company_id").agg(F.max((F.trim(profile_text) != "").cast("int")).alias("_profile"))
    theirs = projects.groupBy("company_id").agg(F.max((F.trim(project_text) != "").cast("int")).alias("_projects"))
    both = companies.select("company_id").join(own.withColumn("_has", F.lit(1)), "company_id", "left").join(theirs.withColumn("_some", F.lit(1)), "company_id", "left")
    full = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    error = F.when(F.col("_has").isNull(), "no profile").when(F.col("_some").isNull(), "no project").when(~full("_profile"), "blank profile").when(~full("_projects"), "blank projects")
    return both.select("company_id", error.alias("error"))


def _filled(template: str, values: dict[str, Column]) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def mail_draft(requests: DataFrame, companies: DataFrame, partners: DataFrame, notices: DataFrame, subject: str = SUBJECT, body: str = BODY) -> DataFrame:
    """(request_id, to, subject, body, error) of requests (request_id, company_id, partner_id, notice_id, help_needed).

    companies: (company_id, company_name, contact_name); partners: (partner_id, partner_name, email); notices: (notice_id,
    title). error is the first of ``no company``, ``no partner``, ``no address``, ``no notice``; with one there is no draft.
    """
    rows = requests.join(companies.withColumn("_c", F.lit(1)), "company_id", "left").join(partners.withColumn("_p", F.lit(1)), "partner_id", "left").join(notices.withColumn("_n", F.lit(1)), "notice_id", "left")
    error = F.when(F.col("_c").isNull(), "no company").when(F.col("_p").isNull(), "no partner").when(F.coalesce("email", F.lit("")) == "", "no address").when(F.col("_n").isNull(), "no notice")
    contact = F.coalesce(F.nullif("contact_name", F.lit("")), F.lit(CONTACT))
    values = {"partner_name": F.col("partner_name"), "company_name": F.col("company_name"), "contact_name": contact, "project_title": F.col("title"), "help_needed": F.col("help_needed")}
    fine = lambda c: F.when(error.isNull(), c)
    return rows.select("request_id", fine(F.col("email")).alias("to"), fine(_filled(subject, {"company_name": F.col("company_name")})).alias("subject"), fine(_filled(body, values)).alias("body"), error.alias("error"))
