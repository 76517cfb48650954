"""Chunks of a text longer than any cap."""

from pyspark.sql import functions as F

from tessera.operators import chunk as C


def test_long_text_is_chunked_to_its_end(spark):
    n = 999 * 462 + 512 + 463  # two windows more than a thousand
    df = spark.range(1).select(F.lit(1).alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: i.cast("string")), " ").alias("text"))
    got = {r.chunk_index: (r.token_count, r.content.split(" ")[0], r.content.split(" ")[-1]) for r in C.chunk_simple(df).collect()}
    want = {i: (min(n - s, 512), str(s + 1), str(min(s + 512, n))) for i, s in enumerate(range(0, n - 50, 462))}
    assert got == want and len(got) == 1002
    assert C.chunk_simple(df, max_chunks=3).count() == 3
