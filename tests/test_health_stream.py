"""The stream's state equals the fold over all rows: late rows, small delays, several batches, and a restart."""

import datetime as dt
import random

from pyspark.sql import functions as F

from feedloom.operators import runs
from feedloom.streaming import health

KINDS = ["fetch", "parse"]
SCHEMA = "source string, ts timestamp, id long, kind string, failed boolean, extra int"


def rows(n, seed):
    rng = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    made = []
    for i in range(n):
        source = rng.choice(["hot", "hot", "hot", "a", "b", None])
        failed = source == "a" or rng.random() < 0.7
        made.append((source, start + dt.timedelta(seconds=60 * i + rng.choice([0, 0, -900, -1500])), i, rng.choice([*KINDS, None]), failed, 1))
    return made


def run(spark, tmp_path, batches):
    for i, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{i}")
    for i in range(len(batches)):  # each folder is a run of its own, so all but the first are restarts
        spark.read.parquet(f"{tmp_path}/in{i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
        health.health_stream(stream, f"{tmp_path}/out", f"{tmp_path}/check", KINDS, "30 minutes").awaitTermination()
    return sorted((tuple(r) for r in health.current(spark, f"{tmp_path}/out", "string", KINDS).collect()), key=repr)


def fold(spark, made):
    df = spark.createDataFrame(made, SCHEMA)
    both = runs.counters("source", "kind", KINDS)(df).alias("c").join(runs.health("source", ["ts", "id"], "failed")(df.filter("source is not null")).alias("h"), "source")
    return sorted((tuple(r) for r in both.select("source", "error_count", F.col("consecutive_errors"), *KINDS, "health_status").collect()), key=repr)


def test_equal_to_the_fold(spark, tmp_path):
    made = rows(400, 1)
    got = run(spark, tmp_path, [made[:150], made[150:290], made[290:]])
    assert [r for r in got if r[0] is not None] == fold(spark, made) and len(got) == 4


def test_no_rows(spark, tmp_path):
    assert health.current(spark, f"{tmp_path}/none", "string", KINDS).count() == 0
