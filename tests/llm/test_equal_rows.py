"""Packing of repeated rows."""

from collections import defaultdict

from pyspark.sql import functions as F

from abacist.llm import sos_packing
from abacist.llm.workspace import stored


def test_equal_rows_share_groups(spark):
    """100,000 equal pieces: every group gets its part, sequences are full and their numbers are of one sequence each."""
    one = spark.range(100_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(1).cast("long").alias("doc_key"), F.lit(0).alias("piece"),
                                      F.lit(0).cast("long").alias("start"), F.lit(600).cast("long").alias("length"), F.lit(9).cast("long").alias("ids_crc32"))
    rows = stored(one, "equal")
    first = sos_packing._packed(rows, 7, 2048, 0)
    sizes = [r["count"] for r in first.groupBy((F.col("sequence_id") / (1 << sos_packing.SEQUENCE_BITS)).cast("long")).count().collect()]
    assert len(sizes) == 7 and max(sizes) < 1.1 * 100_000 / 7
    at = defaultdict(list)
    for r in sos_packing.pack(rows, 2048).collect():
        at[r["sequence_id"]].append(r["offset"])
    assert sum(map(len, at.values())) == 100_000 and all(sorted(x) == [0, 600, 1200][: len(x)] for x in at.values())
    assert len(at) <= -(-100_000 // 3) + 7
