"""Vectors that are told in thousandths."""

from tendril.plans import registry
from tendril.providers import HashProvider
from tests.compare import duck, same


def test_a_half(spark, tmp_path):
    """7 of 80 is 87.5 thousandths, which single precision tells as less."""
    counts, words, taken = [79, 7, 10, 3, 1], [], set()
    assert sum(c * c for c in counts) == 80 * 80
    for k in range(1000):
        place = next(i for i, x in enumerate(HashProvider(64).embed([f"w{k}"])[0]) if x)
        if place not in taken and len(words) < len(counts):
            taken.add(place)
            words.append(f"w{k}")
    text = " ".join(" ".join([w] * c) for w, c in zip(words, counts, strict=True))
    spark.createDataFrame([(1, text, "fr", "s"), (2, "x", "en", "s"), (3, None, "fr", "s")], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/t/documents.parquet")
    spark.createDataFrame([(2, [0.0875, -0.5, 0.0])], "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/t/embeddings.parquet")
    found = {r.chunk_id: r.vector for r in registry.QUERIES["embed_chunks"](spark, f"{tmp_path}/t").collect()}
    assert "88" in found[1].replace("-", "").replace(":", " ").split()
    con = duck(f"{tmp_path}/none")
    for name in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/t/{name}.parquet/*.parquet'")
    same(con, registry.QUERIES["embed_chunks"](spark, f"{tmp_path}/t"), registry.ORACLE_SQL["embed_chunks"])
