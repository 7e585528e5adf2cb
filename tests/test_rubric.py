"""The rubric of a notice, whole."""

from pyspark.sql import functions as F

from tendril.operators import scoring
from tendril.plans import label_queries, registry
from tests.compare import duck, same


def test_one_text_for_each_notice(spark):
    """Many parts of places are one text, a null notice's too; a notice without rubric chunks has the template."""
    told = F.when(F.col("id") % 3 == 0, F.concat(F.lit("license tion 1 a 2 a 3 a 4 a "), F.col("id").cast("string"))).otherwise("nothing")
    chunks = spark.range(40).select(F.when(F.col("id") < 30, "n").alias("notice_id"), F.col("id").alias("chunk_id"), F.col("id").cast("int").alias("chunk_index"), told.alias("content"))
    chunks = chunks.unionByName(spark.createDataFrame([("m", 99, 0, "nothing")], chunks.schema))
    found = {r.notice_id: (r.rubric, r.n_chunks) for r in scoring.rubric_text(chunks, "template", label_queries._RUBRIC, places=4).collect()}
    text = lambda ids: "\n\n".join(f"license tion 1 a 2 a 3 a 4 a {k}" for k in ids if k % 3 == 0)
    assert found == {"n": (text(range(30)), 10), None: (text(range(30, 40)), 4), "m": ("template", 0)}


def test_query(spark):
    d = "/root/testdata/sf0.01"
    df = registry.QUERIES["rubric_text"](spark, d)
    assert df.columns == ["notice_id", "rubric", "n_chunks"]
    same(duck(d), df, registry.ORACLE_SQL["rubric_text"])
