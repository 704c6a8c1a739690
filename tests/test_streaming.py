from __future__ import annotations

from pyspark.sql import functions as F

from evidra.streaming import limits


def test_a_stream_gives_the_windows_of_its_table(spark, tmp_path):
    log = [(k, "search" if k % 3 else "core", 10 * k) for k in range(60)] + [(98, None, 5), (99, "core", None)]
    rows = spark.createDataFrame(log, "id int, kind string, s long").withColumn("at", F.timestamp_seconds("s"))
    rows.coalesce(1).sortWithinPartitions("s").write.parquet(f"{tmp_path}/log")
    late = spark.createDataFrame([(100, "core", 100_000)], "id int, kind string, s long").withColumn("at", F.timestamp_seconds("s"))
    whole = limits.window_totals(rows, "kind", "at", 60, 30).collect()
    want = {}
    for _, kind, s in log:
        if kind and s is not None:
            for start in (s // 30 * 30, s // 30 * 30 - 30):
                want[kind, start] = want.get((kind, start), 0) + 1
    assert {(r["kind"], int(r["start"].timestamp())): r["requests"] for r in whole} == want
    late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/log")
    query = limits.window_totals(stream, "kind", "at", 60, 30).writeStream.outputMode("append").format("memory").queryName("told").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    told = {(r["kind"], int(r["start"].timestamp())): r["requests"] for r in spark.table("told").collect()}
    assert told.items() <= want.items() and told
    over = limits.overruns(limits.window_totals(rows, "kind", "at", 60, 30), "kind", {"search": 3, "core": 2}).collect()
    assert {(r["kind"], int(r["start"].timestamp())): r["over"] for r in over} == {(k, s): n - {"search": 3, "core": 2}[k] for (k, s), n in want.items() if n > {"search": 3, "core": 2}[k]}
