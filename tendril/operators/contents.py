"""Headers of texts, from their tables of contents.

An entry is a line of the front matter with a title, leaders or a gap, and a page number at its end. Of the runs of entries
whose pages never fall and that stand close together the longest is the table of contents, of equally long ones the first.
Levels come from a stack of numbering styles: a style that is open is gone back to, another one goes a level deeper. A topic
that the title does not tell is that of the entry above. Entries are then aligned to the lines behind the table of contents:
each to the first line of its title behind the line of the entry before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import chunk_values as V
from ..functions.storage import materialize
from ..functions.text import strip

FRONT, LEAST, GAP, LONGEST = 20_000, 3, 5, 200


def key(title: Column) -> Column:
    """A title without signs, number, brackets and blanks, as headers are compared."""
    bare = F.regexp_replace(F.regexp_replace(strip(title), V.SIGNS, ""), V.NUMBER, "")
    return F.replace(F.regexp_replace(bare, V.ASIDE, ""), F.lit(" "), F.lit(""))


def _style(title: Column) -> Column:
    """The place of the first style of numbering that fits, after the last where none does."""
    tried = [F.when(title.rlike(f"^{p}"), k) for k, p in enumerate(V.NUMBERING)]
    return F.coalesce(*tried, F.lit(len(V.NUMBERING)))


def entries(docs: DataFrame, doc: str = "doc_id", text: str = "content", front: int = FRONT, least: int = LEAST, gap: int = GAP) -> DataFrame:
    """(doc, ord, line_no, exact_header, page): the table of contents of each text; none where fewer than ``least`` entries run on."""
    lines = docs.select(doc, F.posexplode(F.split(F.substring(text, 1, front), "\n", -1)).alias("line_no", "line"))
    # What an entry ends in is seen at once; of long lines without it nothing more is tried.
    lines = lines.where(F.col("line").rlike(V.PAGE_END))
    found = lines.select(doc, "line_no", F.regexp_extract("line", V.ENTRY, 1).alias("exact_header"), F.regexp_extract("line", V.ENTRY, 2).try_cast("int").alias("page"))
    found = found.where(F.col("page").isNotNull() & (F.length("exact_header") <= LONGEST) & ~F.col("exact_header").rlike(V.APPENDED))
    order = Window.partitionBy(doc).orderBy("line_no")
    begins = (F.col("page") < F.lag("page").over(order)) | (F.col("line_no") - F.lag("line_no").over(order) > gap)
    found = found.withColumn("_begins", F.coalesce(begins, F.lit(True)).cast("int")).withColumn("_run", F.sum("_begins").over(order))
    found = found.withColumn("_n", F.count("*").over(Window.partitionBy(doc, "_run")))
    best = F.max(F.struct("_n", (-F.col("_run")).alias("minus"))).over(Window.partitionBy(doc))
    found = found.withColumn("_best", best).where((F.col("_run") == -F.col("_best.minus")) & (F.col("_n") >= least))
    return found.select(doc, (F.row_number().over(order) - 1).alias("ord"), "line_no", "exact_header", "page")


def find_headers(docs: DataFrame, doc: str = "doc_id", text: str = "content", front: int = FRONT, least: int = LEAST, gap: int = GAP) -> DataFrame:
    """(doc, ord, exact_header, level, page, l_topic, s_topic, body_line) of the entries of each text's table of contents.

    body_line counts from 0 and is null where no line behind the table of contents has the title. A text is named by its
    ``doc``; null and empty texts, and those without a table of contents, have no rows. What is gathered for one text is its table of contents.
    """
    listed = entries(docs, doc, text, front, least, gap)
    told = reduce(lambda rest, t: F.when(F.col("exact_header").rlike(t[1]), t[0]).otherwise(rest), reversed(V.TITLE_TOPICS), F.lit(None).cast("string"))
    listed = listed.select("*", key(F.col("exact_header")).alias("_key"), _style(F.col("exact_header")).alias("style"), told.alias("told"), F.max("line_no").over(Window.partitionBy(doc)).alias("_end"))
    # Tables of contents are few words of the texts, and read twice below.
    listed = materialize(listed, "listed")
    # Only short lines can be titles, so only they are dealt, and of each text without a table of contents none.
    lines = docs.select(doc, F.posexplode(F.split(text, "\n", -1)).alias("at", "line")).where((F.length("line") <= 2 * LONGEST) & ~F.col("line").rlike(V.LEADERS))
    lines = lines.select(doc, "at", key(F.col("line")).alias("_key")).where("_key != ''")
    met = listed.join(lines, [doc, "_key"], "left").where("at is null or at > _end or _key = ''")
    places = met.groupBy(doc, "ord").agg(F.sort_array(F.collect_list(F.when(F.col("at") > F.col("_end"), F.col("at")))).alias("places"))
    whole = listed.join(places, [doc, "ord"], "left").groupBy(doc).agg(F.sort_array(F.collect_list(F.struct("ord", "exact_header", "page", "style", "told", F.coalesce("places", F.array().cast("array<int>")).alias("places")))).alias("e"))

    def step(state: Column, x: Column) -> Column:
        open_at = F.array_position(state["styles"], x["style"]).cast("int")
        styles = F.when(open_at > 0, F.slice(state["styles"], F.lit(1), open_at)).otherwise(F.concat(state["styles"], F.array(x["style"])))
        level = F.when(open_at > 0, open_at).otherwise(F.size(state["styles"]) + 1)
        topic = F.coalesce(x["told"], F.when(level > 1, F.get(state["topics"], level - 2)), F.lit(V.OTHER_TOPIC))
        body = F.array_min(F.filter(x["places"], lambda p: p > state["last"]))
        out = F.struct(x["ord"].alias("ord"), level.alias("level"), topic.alias("l_topic"), body.alias("body_line"))
        topics = F.concat(F.slice(state["topics"], F.lit(1), level - 1), F.array(topic))
        return F.struct(styles.alias("styles"), topics.alias("topics"), F.coalesce(body, state["last"]).alias("last"), F.concat(state["out"], F.array(out)).alias("out"))

    begun = F.expr("named_struct('styles', cast(array() as array<int>), 'topics', cast(array() as array<string>), 'last', -1, 'out', cast(array() as array<struct<ord:int,level:int,l_topic:string,body_line:int>>))")
    placed = whole.select(doc, "e", F.aggregate("e", begun, step, lambda s: s["out"]).alias("out"))
    rows = placed.select(doc, F.explode(F.arrays_zip("e", "out")).alias("x"))
    title = strip(F.regexp_replace(F.regexp_replace("x.e.exact_header", V.SIGNS, ""), V.TITLE_NUMBER, ""))
    return rows.select(doc, "x.e.ord", "x.e.exact_header", "x.out.level", "x.e.page", "x.out.l_topic", title.alias("s_topic"), "x.out.body_line")
