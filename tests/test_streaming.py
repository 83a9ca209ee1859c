from pyspark.sql import functions as F
from test_dataset import rows
from tickforge.operators import book
from tickforge.streaming import books

SCHEMA = "day string, seq long, ts_ns long, action string, side string, order_id long, price long, size long"


def test_replay_equals_batch_and_late_rows_are_told(spark, tmp_path):
    given = rows(2, 120)
    for k in range(0, len(given), 60):
        spark.createDataFrame(given[k : k + 60] + ([given[3]] if k == 60 else []), SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = books.snapshots(stream, every=3, levels=5).writeStream.format("memory").queryName("snaps").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("snaps")
    want = book.reconstruct(spark.createDataFrame(given, SCHEMA), 5)
    want = want.where((F.col("seq") % 120 + 1) % 3 == 0).select("seq", "bid_px", "bid_sz", "ask_px", "ask_sz", "best_bid", "best_ask").orderBy("seq").collect()
    assert got.where("NOT late").drop("day", "ts_ns", "late").orderBy("seq").collect() == want
    assert [r.seq for r in got.where("late").collect()] == [3]


def test_windowed_counts(spark):
    x = books.session_counts(spark.createDataFrame(rows(1, 50), SCHEMA)).agg(F.sum("n").alias("n")).first()
    assert x.n == 50
