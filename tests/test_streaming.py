"""Streams against the batch results of the same rules."""

from pyspark.sql import functions as F

from memspan.operators import lifecycle
from memspan.plans.lens import Lens
from memspan.streaming import hooks


def run(stream, name, mode):
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def source(spark, df, path):
    df.coalesce(1).write.parquet(str(path))
    return spark.readStream.schema(df.schema).parquet(str(path))


def test_session_counts(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    run(hooks.session_counts(source(spark, events, tmp_path / "e")), "counts", "complete")
    assert {(r.user_id, r.n) for r in spark.table("counts").collect()} == {(r.user_id, r.n) for r in hooks.session_counts(events).collect()}


def test_windows_close_behind_the_watermark(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    run(hooks.late_windows(source(spark, events, tmp_path / "w"), "ts"), "windows", "append")
    done = spark.table("windows")
    assert 0 < done.agg(F.sum("n")).head()[0] <= events.count()


def test_ttl_dedup(spark, sf, tmp_path):
    keyed = Lens(spark, sf).ev.select(F.concat(F.col("user_id").cast("string"), F.lit(":"), "event_type").alias("key"), F.col("event_id").alias("id"), "ts_us")
    ttl = 21_600_000_000
    run(hooks.ttl_dedup(source(spark, keyed, tmp_path / "d"), ttl), "dedup", "append")
    assert {r.id for r in spark.table("dedup").collect()} == {r.id for r in lifecycle.ttl_dedup(keyed, "key", "ts_us", "id", ttl).collect()}


def test_open_runs(spark, sf, tmp_path):
    obs = Lens(spark, sf).observation
    kind = F.col("obs_type")
    rows = obs.select(F.col("session_id").alias("key"), "id", "ts_us", F.when(kind == "conversation", "open").when(kind == "task", "close").otherwise("other").alias("kind"))
    run(hooks.open_runs(source(spark, rows, tmp_path / "r")), "runs", "append")
    batch = lifecycle.run_numbers(rows, "key", ["ts_us", "id"], F.col("kind") == "open", F.col("kind") == "close").where("run_no is not null")
    assert {(r.key, r.id, r.run_no) for r in spark.table("runs").collect()} == {(r.key, r.id, r.run_no) for r in batch.collect()}
