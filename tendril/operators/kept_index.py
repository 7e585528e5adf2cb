"""A BM25 index that is kept: postings in blocks on disk, with what bounds each block's scores.

A folder holds three tables. ``blocks`` has the postings: one row is a run of at most BLOCK chunks that hold one term in one
notice, with the greatest term frequency and the least length for each time that the term stands there among them; frequent terms are parted by how much a posting
says, so that few blocks hold what counts most. Chunks are put into blocks where they stand, a run of them at a time, and blocks alone are dealt to folders. ``terms`` has the number of chunks of each term,
``corpus`` the number of chunks and their length. All rows belong to a generation: an append writes one, its
``corpus`` row last, and only what has such a row is read. So an append that fails leaves nothing to be seen, and
statistics are sums over generations. ``blocks`` and ``terms`` lie in folders by a hash of the term, of which a search opens
those of its terms.

The best n of a group (a query, or a query in a notice) are found without all postings. A block's bound is the score of its
two figures, which no posting in it exceeds, whatever the statistics have become. First the blocks with the greatest bounds, as
many as hold n postings, are scored: the n-th best of these partial scores is a threshold. A block can bring a new chunk
among the best only if its bound and the greatest bounds of the group's other terms reach the threshold; all others are
skipped. A chunk that such blocks have brought is given up if its score and what skipped blocks might add are below the
threshold, which has risen. Only skipped blocks of its run whose range of ids holds a chunk that is left are scored after all.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.batches import slices
from ..functions.storage import materialize
from .lexical import B, K1, query_terms, top

#: Postings of a block, folders of terms, and steps of what a posting says.
BLOCK, FOLDERS, TIERS = 32, 64, 24
#: Words of the chunks whose postings are put into blocks together.
RUN = 1 << 22
#: Levels of bounds, up to the most that a term can add to a score.
LEVELS = 64
#: Scores are equal in so many digits; what may be rounded up to a threshold is kept.
DIGITS = 6
MARGIN = 2 * 10.0**-DIGITS


def _folder(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(FOLDERS)).cast("int")


def _meet(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", more: Column | None = None) -> DataFrame:
    """A join on equal columns, nulls equal to nulls, and on what more is asked."""
    named = right.select(*[F.col(c).alias(f"_{c}") for c in on], *[c for c in right.columns if c not in on])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on] + ([] if more is None else [more])
    return left.join(named, same, how).drop(*[f"_{c}" for c in on])


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of chunks (chunk_id, notice_id, l_topic, dl, words, times); a worker holds the chunks of about RUN words at once,
    and their postings. Each word counts ``times``; where that is null, it counts once and the row is a whole chunk."""
    held, size = [], 0
    for b in slices(batches, 1 << 24):
        held.append(b)
        size += len(b.column("words").flatten())
        if size >= RUN:
            yield from _blocks(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held, size = [], 0
    if held:
        yield from _blocks(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def _blocks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The blocks of a batch of chunks: by term and notice, from what says most, as far as their own mean length tells,
    then by id; the least id names the run, outside which its whole chunks have no posting. A block without a term has the lengths of all whole chunks."""
    times = pc.fill_null(b.column("times"), 1).to_numpy()
    whole = b.column("times").null_count > 0
    by_id = pc.sort_indices(b.column("chunk_id")).to_numpy()
    rank = np.empty(len(by_id), np.int64)
    rank[by_id] = np.arange(len(by_id))
    code = b.column("words").flatten().dictionary_encode()
    valid = code.is_valid()
    chunk = rank[pc.list_parent_indices(b.column("words")).filter(valid).to_numpy()]
    key = code.indices.filter(valid).to_numpy().astype(np.int64) * b.num_rows + chunk
    key.sort()
    changes = lambda x: np.flatnonzero(np.append(True, x[1:] != x[:-1])[: len(x)])
    begin = changes(key)
    term, chunk = np.divmod(key[begin], b.num_rows)
    tf = (np.diff(np.append(begin, len(key))) * times[by_id][chunk]).astype(np.int32)
    length = pc.fill_null(b.column("dl"), 0).to_numpy()
    dl = length[by_id][chunk]
    notice = b.column("notice_id").dictionary_encode("encode")
    run = term * len(notice.dictionary) + notice.indices.to_numpy()[by_id][chunk]
    tier = (TIERS * tf / (tf + K1 * (1 - B + B * dl / (length.mean() or 1.0)))).astype(np.int64)
    order = np.argsort(run * (TIERS + 1) + TIERS - tier, kind="stable")
    term, chunk, tf, dl, run, tier = term[order], chunk[order], tf[order], dl[order], run[order], tier[order]
    # Long runs are also cut where the tier changes.
    begin = changes(run)
    long = np.repeat(np.diff(np.append(begin, len(run))), np.diff(np.append(begin, len(run)))) > BLOCK
    begin = changes(run * (TIERS + 1) + np.where(long, tier, 0))
    parts = -(-np.diff(np.append(begin, len(run))) // BLOCK)
    first = np.repeat(begin, parts) + BLOCK * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
    ends = np.append(first, len(run))
    at = lambda c, places: b.column(c).take(pa.array(by_id[places]))
    lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), x)
    found = pa.RecordBatch.from_arrays(
        [code.dictionary.take(pa.array(term[first])), at("notice_id", chunk[first]), pa.array(np.diff(ends)), pa.array(np.maximum.reduceat(tf, first)), pa.array(np.minimum.reduceat(dl / tf, first)), at("chunk_id", np.minimum.reduceat(chunk, first)), at("chunk_id", np.maximum.reduceat(chunk, first)), lists(at("chunk_id", chunk)), lists(at("l_topic", chunk)), lists(pa.array(dl)), lists(pa.array(tf)), at("chunk_id", np.zeros(len(first), np.int64)) if whole else pa.nulls(len(first), b.column("chunk_id").type)],
        ["term", "notice_id", "n", "tf_most", "thinnest", "first", "last", "chunk_ids", "topics", "dls", "tfs", "run"],
    )
    if len(run):
        yield from slices(iter([found]), 1 << 23)
    if whole:
        none = [pa.nulls(1, f.type) for f in found.schema]
        none[found.schema.get_field_index("dls")] = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column("dl"))
        yield pa.RecordBatch.from_arrays(none, found.schema.names)


@dataclass
class KeptIndex:
    """An index in a folder that the driver and all executors share."""

    spark: SparkSession
    path: str
    tokens: Callable[[Column], Column] = X.tokens

    def append(self, chunks: DataFrame, chunk: str = "chunk_id", notice: str = "notice_id", text: str = "content", topic: str = "l_topic") -> None:
        """Add chunks whose ids the index does not have; the first append makes the index. A null text is a chunk without
        terms, and without a length."""
        ids = ["chunk_id", "notice_id", "l_topic"]
        words = chunks.select(F.col(chunk).alias("chunk_id"), F.col(notice).alias("notice_id"), F.col(topic).alias("l_topic"), self.tokens(F.col(text)).alias("words")).withColumn("dl", F.size("words"))
        once = words.groupBy("chunk_id").count().where("count > 1").isEmpty()
        if once:
            # Where no chunk comes twice, which ids alone tell, each has its own terms, and no posting is dealt.
            rows = words.withColumn("times", F.lit(None).cast("int"))
        else:
            counted = words.select(*ids, "dl", F.explode("words").alias("term")).where("term is not null").groupBy(*ids, "dl", "term").agg(F.count("*").cast("int").alias("times"))
            rows = counted.select(*ids, "dl", F.array("term").alias("words"), "times")
        generation = uuid.uuid4().hex
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        schema = f"term string, notice_id {kinds['notice_id']}, n bigint, tf_most int, thinnest double, first {kinds['chunk_id']}, last {kinds['chunk_id']}, chunk_ids array<{kinds['chunk_id']}>, topics array<{kinds['l_topic']}>, dls array<int>, tfs array<int>, run {kinds['chunk_id']}"
        blocks = rows.select(*ids, "dl", "words", "times").mapInArrow(_inverted, schema).withColumn("folder", _folder(F.col("term")))
        # Blocks are dealt, not postings; a folder that has grown large is shared by several tasks.
        dealt = blocks.hint("rebalance", "folder").sortWithinPartitions("folder").withColumn("block", F.monotonically_increasing_id())
        dealt.write.partitionBy("folder").parquet(f"{self.path}/blocks/generation={generation}")
        written = self.spark.read.schema("term string, n long, dls array<int>, folder int").parquet(f"{self.path}/blocks/generation={generation}")
        terms = written.where("term is not null").groupBy("folder", "term").agg(F.sum("n").alias("n"))
        terms.withColumn("generation", F.lit(generation)).repartition("folder").write.partitionBy("generation", "folder").mode("append").parquet(f"{self.path}/terms")
        lengths = written.where((F.col("folder") == _folder(F.lit(None).cast("string"))) & F.col("term").isNull()).select(F.explode("dls").alias("dl")) if once else words.groupBy(*ids).agg(F.max("dl").alias("dl"))
        told = lengths.agg(F.count("*").alias("n_chunks"), F.count("dl").alias("n_lengths"), F.coalesce(F.sum("dl"), F.lit(0)).cast("long").alias("length"))
        told.withColumn("generation", F.lit(generation)).coalesce(1).write.mode("append").parquet(f"{self.path}/corpus")

    def corpus(self) -> tuple[list[str], int, float]:
        """(generations, number of chunks, mean length)."""
        rows = self.spark.read.schema("n_chunks long, n_lengths long, length long, generation string").parquet(f"{self.path}/corpus").collect()
        n = sum(r.n_lengths for r in rows)
        return [r.generation for r in rows], sum(r.n_chunks for r in rows), sum(r.length for r in rows) / n if n else 0.0

    def _read(self, table: str, generations: list[str], folders: list[int]) -> DataFrame:
        """The committed rows of the folders; partitions of others are not listed as files to read."""
        found = self.spark.read.parquet(f"{self.path}/{table}")
        return found.where(F.col("generation").isin(generations) & F.col("folder").isin(folders))

    def best(self, queries: DataFrame, limit: int, by_notice: bool = False, query: str = "query_id", text: str = "text", topics: tuple[str, ...] | None = None, k1: float = K1, b: float = B) -> tuple[DataFrame, DataFrame]:
        """((query_id, notice_id, chunk_id, score, rank), (n_read, n_postings)): of each query, or of each query and notice,
        the ``limit`` best chunks, equal scores by id; and how many of the postings of its terms were scored.

        Rows and scores are those of ``lexical.search`` and ``lexical.top``. A query without terms finds nothing.
        """
        generations, n_chunks, mean = self.corpus()
        asked = materialize(query_terms(queries.select(F.col(query).alias("query_id"), F.col(text).alias("text")), tokens=self.tokens).withColumn("folder", _folder(F.col("term"))), "asked")
        folders = [r.folder for r in asked.select("folder").distinct().collect()]
        if not mean or not folders:  # no chunk has a term
            nothing = self.spark.createDataFrame([], "query_id string, notice_id string, chunk_id long, score double, rank int")
            return nothing, self.spark.createDataFrame([(0, 0)], "n_read long, n_postings long")
        df = self._read("terms", generations, folders).join(asked.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log(1 + (n_chunks - F.col("df") + 0.5) / (F.col("df") + 0.5))
        asked = materialize(asked.join(df, "term").select("query_id", "term", idf.alias("idf")), "asked")
        weight = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / F.lit(mean)))
        key = ["generation", "block"]
        group = ["query_id", "notice_id"] if by_notice else ["query_id"]
        # The folders are opened once; what follows reads the blocks of the queries' terms alone.
        blocks = materialize(self._read("blocks", generations, folders).join(asked.select("term").distinct(), "term", "left_semi"), "blocks")
        bounds = blocks.select(*key, "term", "notice_id", "n", "tf_most", "thinnest", "first", "last", "run").join(asked, "term")
        bounds = materialize(bounds.withColumn("bound", F.col("idf") * (k1 + 1) / (1 + k1 * (1 - b) / F.col("tf_most") + k1 * b * F.col("thinnest") / F.lit(mean))), "bounds")
        step = F.col("idf") * (k1 + 1) / LEVELS
        bounds = bounds.withColumn("level", F.ceil(F.col("bound") / step).cast("int")).withColumn("bound", F.col("level") * step)
        levels = materialize(bounds.groupBy(*group, "term", "level").agg(F.sum("n").alias("n"), F.max("bound").alias("bound")), "levels")

        def postings(chosen: DataFrame) -> DataFrame:
            """(query_id, notice_id, term, run, chunk_id, score) of the postings of chosen blocks."""
            held = blocks.select(*key, "run", "chunk_ids", "topics", "dls", "tfs").join(chosen.select("query_id", "notice_id", "term", "idf", *key), key)
            rows = held.select("query_id", "notice_id", "term", "idf", "run", F.explode(F.arrays_zip("chunk_ids", "topics", "dls", "tfs")).alias("p"))
            if topics is not None:
                rows = rows.where(F.col("p.topics").isin(*topics))
            return rows.select("query_id", "notice_id", "term", "run", F.col("p.chunk_ids").alias("chunk_id"), (F.col("idf") * weight(F.col("p.tfs"), F.col("p.dls"))).alias("score"))

        def threshold(scored: DataFrame) -> DataFrame:
            """The ``limit``-th best score of each group that has as many chunks."""
            best = scored.withColumn("_at", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("score")))).where(F.col("_at") <= limit)
            return best.groupBy(*group).agg((F.min("score") - MARGIN).alias("least"), F.count("*").alias("_n")).where(F.col("_n") == limit).drop("_n")

        def reaching(rows: DataFrame, least: DataFrame, value: str) -> DataFrame:
            return _meet(rows, least, group, "left").where(F.col("least").isNull() | (F.col(value) >= F.col("least"))).drop("least")

        chunk = ["query_id", "notice_id", "chunk_id"]
        summed = lambda rows: rows.groupBy(*chunk).agg(F.sum("score").alias("score"))
        before = Window.partitionBy(*group).orderBy(F.desc("bound"), "term", "level").rowsBetween(Window.unboundedPreceding, -1)
        seeds = levels.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))).where(F.col("_before") < limit).select(*group, "term", "level")
        least = threshold(summed(postings(_meet(bounds, seeds, [*group, "term", "level"], "left_semi"))))
        # From the lowest level up: what a chunk can have by levels up to this one alone, one of each term.
        own = F.col("bound") - F.coalesce(F.lag("bound").over(Window.partitionBy(*group, "term").orderBy("level")), F.lit(0.0))
        up_to = F.sum("_own").over(Window.partitionBy(*group).orderBy("bound", "term", "level").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        alone = levels.withColumn("_own", own).withColumn("_up_to", up_to)
        chosen = reaching(alone, least, "_up_to").select(*group, "term", "level")
        essential = materialize(_meet(bounds, chosen, [*group, "term", "level"], "left_semi"), "essential")
        first = materialize(postings(essential), "scores")
        skipped = materialize(_meet(bounds, chosen, [*group, "term", "level"], "left_anti"), "skipped")
        # What the skipped blocks of all terms might add to a chunk of a group.
        more = skipped.groupBy(*group, "term").agg(F.max("bound").alias("most")).groupBy(*group).agg(F.sum("most").alias("more"))
        partial = first.groupBy(*chunk).agg(F.sum("score").alias("score"), F.min("run").alias("own_run"))
        least = threshold(partial)
        hopes = _meet(partial, more, group, "left").withColumn("hope", F.col("score") + F.coalesce("more", F.lit(0.0)))
        left = materialize(reaching(hopes, least, "hope").select(*chunk, "own_run"), "candidates")
        near = F.col("chunk_id").between(F.col("first"), F.col("last")) & (F.col("run").isNull() | (F.col("run") == F.col("own_run")))
        again = materialize(_meet(skipped, left, ["query_id", "notice_id"], "left_semi", near), "again")
        whole = first.unionByName(postings(again))
        scored = summed(_meet(whole, left, chunk, "left_semi")).withColumn("score", F.round("score", DIGITS))
        read = essential.select("n").unionByName(again.select("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_read"))
        every = bounds.agg(F.sum("n").alias("n_postings"))
        return top(scored, limit, group), read.join(every)
