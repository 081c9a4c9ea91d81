import os

from codemap_spark.streaming import changes
from pyspark.sql import functions as F

SCHEMA = "path string, text string"


def test_state_follows_changes_and_deletions(spark, tmp_path):
    batches = [[("a", "1"), ("b", "2")], [("b", "3"), ("c", "4")], [("a", None), ("c", None), ("c", "5")], [("d", "6")]]
    state, expected = str(tmp_path / "state"), {"b": "3", "c": "5", "d": "6"}
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes.follow(spark, changes.changes(spark, str(tmp_path / "in"), SCHEMA, 1), state, str(tmp_path / "check")).awaitTermination()
    got = changes.snapshot(spark, state, 3).join(spark.createDataFrame(list(expected.items()), SCHEMA).select("path", F.sha2("text", 256).alias("want")), "path", "full")
    assert all(r.content_hash == r.want for r in got.collect())
    assert sorted(x for x in os.listdir(state) if x.startswith("epoch")) == ["epoch=2", "epoch=3"]
