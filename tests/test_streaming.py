import os

from pyspark.sql import functions as F

from inkspan.streaming import follow


def _feed(spark, path, batches, schema):
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_heads_follow_the_largest_number(spark, tmp_path):
    feed = _feed(spark, tmp_path / "in", [[("a", 3), ("b", 1)], [("a", 2)], [("a", 5), ("b", 1)]], "brain string, seq long")
    q = follow.heads(feed).writeStream.outputMode("update").format("memory").queryName("heads").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.sql("select brain, max(seq) as m, count(*) as n from heads group by brain").collect()
    got = {r.brain: r.m for r in rows}
    assert got == {"a": 5, "b": 1} and all(r.n <= 2 for r in rows)


def test_upsert_sink_equals_last_write(spark, tmp_path):
    feed = _feed(spark, tmp_path / "in", [[(1, 1, "x"), (2, 1, "y")], [(1, 2, "z")]], "k long, n long, v string")
    q = feed.writeStream.foreachBatch(follow.upsert_table(str(tmp_path / "t"), "k", "n")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = max(int(d[1:]) for d in os.listdir(tmp_path / "t"))
    assert {r.k: r.v for r in spark.read.parquet(f"{tmp_path}/t/v{last}").collect()} == {1: "z", 2: "y"}


def test_sessions_and_months(spark, tmp_path):
    rows = [(1, "2026-01-01 00:00:00", "a"), (1, "2026-01-01 00:10:00", "a"), (1, "2026-01-01 02:00:00", "a")]
    events = spark.createDataFrame(rows, "user_id long, t string, kind string").withColumn("ts", F.to_timestamp("t"))
    assert sorted(r.n for r in follow.sessions(events).collect()) == [1, 2]
    assert follow.by_month(events).first().n == 3


def test_months_close_by_watermark(spark, tmp_path):
    """A month's count comes out once, after the watermark has passed its end; rows that are too late are dropped."""
    batches = [[("2026-01-10 00:00:00", "a"), ("2026-01-31 23:00:00", "a"), ("2026-01-05 00:00:00", "b")], [("2026-02-03 00:00:00", "a")], [("2026-02-04 00:00:00", "a"), ("2026-01-09 00:00:00", "a")], [("2026-03-09 00:00:00", "a")], [("2026-03-09 01:00:00", "a")]]
    feed = _feed(spark, tmp_path / "in", batches, "t string, kind string").select(F.to_timestamp("t").alias("ts"), "kind")
    q = follow.by_month(feed, "1 day").writeStream.outputMode("append").format("memory").queryName("months").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = sorted((r.ym, r.kind, r.n) for r in spark.sql("select * from months").collect())
    assert got == [("2026-01", "a", 2), ("2026-01", "b", 1), ("2026-02", "a", 2)]


def test_subscribe_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"brain": "a", "seq": 2}\n{"brain": "a", "seq": 1}\nnonsense\n{"brain": "b", "seq": 3}\n')
    got = []
    run = lambda: follow.subscribe(follow.feed(spark, str(tmp_path / "in")), lambda b, n: got.extend(r.seq for r in b.collect()), str(tmp_path / "c"), since=1, once=True).awaitTermination(120)
    run()
    assert got == [2, 3]
    (tmp_path / "in/b.json").write_text('{"brain": "a", "seq": 5}\n{"brain": "a", "seq": 4}\n')
    run()
    assert got == [2, 3, 4, 5]
