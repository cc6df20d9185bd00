"""The stateful stream against counting all events anew, over several runs of one checkpoint."""

import datetime as dt
import random

from docloom.io import settings
from docloom.streaming import limits


def test_replay_over_restarts_and_days(spark, tmp_path):
    rng = random.Random(4)
    begin = dt.datetime(2024, 1, 1, 23, 50)
    rows = sorted((begin + dt.timedelta(seconds=rng.randint(0, 1800)), rng.choice("abc"), rng.randint(1, 5), i) for i in range(400))
    source, out = tmp_path / "in", str(tmp_path / "out")
    schema = "ts timestamp, who string, n int, event long"
    for part in range(3):
        own = [r for r in rows if part == (r[0] - begin).total_seconds() // 601]
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(str(source / str(part)))
        with settings(spark, **limits.STORE):
            stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(source))
            query = limits.usage_stream(stream, "who", "ts", "n", "event").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            assert query.awaitTermination(240)
    got = {r.id: (r.key, r.requests, r.tokens, r.day_requests, r.day_tokens) for r in spark.read.parquet(out).collect()}
    want = {}
    for at, who, _, i in rows:
        window = [n for t, w, n, _ in rows if w == who and dt.timedelta(0) <= at - t < dt.timedelta(seconds=60)]
        day = [n for t, w, n, _ in rows if w == who and t <= at and t.date() == at.date()]
        want[i] = (who, len(window), sum(window), len(day), sum(day))
    assert got == want
