"""Bursts over several batches, late and out of order rows, restarts."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from exonloom.streaming import stateful

HOUR = 3_600_000


def events(spark, rows):
    return spark.createDataFrame(rows, "user string, ms bigint").select("user", F.timestamp_millis("ms").alias("ts"))


def plain(rows, slack, watermark):
    out = []
    for user in {u for u, _ in rows if u is not None}:
        first, last, n = stateful.bursts_of(np.sort(np.array([t for u, t in rows if u == user])), slack)
        out += [(user, int(a), int(b), int(c)) for a, b, c in zip(first, last, n) if b + slack <= watermark]
    return sorted(out)


def test_bursts_over_batches_and_a_restart(spark, tmp_path):
    rng = random.Random(1)
    rows = sorted(((rng.choice("ab"), 10**12 + rng.randrange(0, 200) * HOUR // 2) for _ in range(120)), key=lambda r: r[1])
    rows += [(None, rows[-1][1])]
    source = str(tmp_path / "in")
    schema = "user string, ts timestamp"
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = lambda: stateful.drain(stateful.bursts(stream(), "user", "ts", "3 hours", "6 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    for k, part in enumerate((rows[:40], rows[40:75])):
        mixed = list(part)
        rng.shuffle(mixed)
        events(spark, mixed).coalesce(1).write.mode("append").parquet(source)
    run()
    seen = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert seen == plain(rows[:75], 3 * HOUR, max(t for _, t in rows[:75]) - 6 * HOUR)
    events(spark, rows[75:]).coalesce(1).write.mode("append").parquet(source)
    run()
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == plain(rows, 3 * HOUR, max(t for _, t in rows) - 6 * HOUR) and len(got) > len(seen)


class Held:
    """A handle that counts what a batch asks of it."""

    def __init__(self):
        self.kept, self.timers, self.calls = None, [], 0

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.kept is not None

    def get(self):
        self.calls += 1
        return self.kept

    def update(self, value):
        self.calls, self.kept = self.calls + 1, value

    def clear(self):
        self.kept = None

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.now


def test_a_batch_reads_and_writes_the_state_of_a_key_once():
    handle, processor, rng = Held(), stateful.Bursts(10, "bigint"), random.Random(5)
    processor.init(handle)
    times, got, handle.now = [], [], 0
    for k in range(6):
        batch = [k * 400 + rng.randrange(1000) for _ in range(80)]
        times, handle.calls, handle.timers = times + batch, 0, []
        handle.now = max(0, k * 400 - 20)
        got += [f for f in processor.handleInputRows((1,), iter([pd.DataFrame({"at": batch[:30]}), pd.DataFrame({"at": batch[30:]})]), handle)]
        assert handle.calls <= 2 and len(handle.timers) <= 1
    rows = sorted(tuple(r) for f in got for r in f[["first_ms", "last_ms", "n"]].itertuples(index=False))
    first, last, n = stateful.bursts_of(np.sort(np.array(times)), 10)
    done = last + 10 <= handle.now
    assert rows == sorted(zip(first[done], last[done], n[done])) and len(rows) > 5
