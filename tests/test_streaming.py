from pyspark.sql import functions as F

from claimframe.streaming import events as E


def source(spark, tmp_path, n=200):
    d = spark.range(n).select(
        F.col("id").alias("event_id"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)).alias("ts"), (F.col("id") % 5).alias("user_id"), F.when(F.col("id") % 3 == 0, "view").otherwise("click").alias("event_type"), (F.col("id") % 100).cast("double").alias("value"), F.lit("{}").alias("props")
    )
    d.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    return spark.read.parquet(str(tmp_path / "in")), E.read_stream(spark, str(tmp_path / "in"))


def test_totals_windows_sessions(spark, tmp_path, rows):
    batch, stream = source(spark, tmp_path)
    E.run_available(E.running_totals(stream, "event_type"), "totals", "complete")
    assert rows(spark.table("totals")) == rows(batch.groupBy("event_type").agg(F.count("*").alias("n")))
    E.run_available(E.tumbling(stream, "1 hour", "1 day", "event_type"), "tumble", "update")
    got = {(r["start"], r["event_type"]): r["n"] for r in spark.table("tumble").collect()}
    want = {(r["s"], r["event_type"]): r["n"] for r in batch.groupBy(F.window("ts", "1 hour")["start"].alias("s"), "event_type").agg(F.count("*").alias("n")).collect()}
    assert got.keys() == want.keys() and max(got.values()) <= max(want.values())
    E.run_available(E.sliding(stream, "1 hour", "30 minutes", "10 minutes"), "slide", "update")
    assert spark.table("slide").count() > 0
    E.run_available(E.sessions(stream, "10 minutes", "1 minute", "user_id"), "sess", "append")


def test_state_and_dedup(spark, tmp_path, rows):
    batch, stream = source(spark, tmp_path)
    E.run_available(E.last_answers(stream), "verdicts", "update")
    last = {r["user_id"]: r["answers"] for r in spark.table("verdicts").groupBy("user_id").agg(F.max("answers").alias("answers")).collect()}
    assert last == {r["user_id"]: r["n"] for r in batch.groupBy("user_id").agg(F.count("*").alias("n")).collect()}
    E.run_available(E.first_deliveries(stream.unionByName(stream), "event_id", "1 day"), "once", "append")
    assert spark.table("once").count() == batch.count()


def test_resumes(spark, tmp_path):
    batch, stream = source(spark, tmp_path)
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    E.resumable(stream, out, cp)
    E.resumable(E.read_stream(spark, str(tmp_path / "in")), out, cp)
    assert spark.read.parquet(out).count() == batch.count()
