"""Live state and alerts: one trigger or many give the same."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fairlead.params import US, TripParams
from fairlead.streaming import live
from fairlead.streaming.ordered import InOrder

T0 = 1784102400
COLUMNS = "boat_id int, seq bigint, time_us bigint, lat double, lon double, sog_ms double, fuel_rate_lph double, is_engine boolean"


def minutes(spans):
    """A position a minute; spans of (minutes, speed, degrees a minute)."""
    out, lat, m = [], 52.0, 0
    for n, sog, step in spans:
        for _ in range(n):
            lat += step
            out.append((m, lat, sog))
            m += 1
    return out


def run(spark, folder, rows, files):
    data = [(1, i, (T0 + m * 60) * US, lat, 4.9, sog, None, False) for i, (m, lat, sog) in enumerate(rows)]
    size = -(-len(data) // files)
    for k in range(files):
        part = spark.createDataFrame(data[k * size : (k + 1) * size], COLUMNS)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in/{k:03d}")
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    out = f"{folder}/out"
    fn = lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(out)
    q = live.live_state(stream, TripParams()).writeStream.foreachBatch(fn).outputMode("update").option("checkpointLocation", f"{folder}/progress")
    q.trigger(availableNow=True).start().awaitTermination()
    states = spark.read.parquet(out)
    alerts = [tuple(r) for r in live.harbour_alerts(states).orderBy("last_data_us").collect()]
    last = live.latest(states).orderBy(F.desc("batch")).drop("batch").first()
    return alerts, last


SEA = (30, 3.0, 0.002)
VOYAGE = minutes([(60, 0.0, 0.0), SEA, (45, 0.0, 0.0), SEA, (5, 0.0, 0.0)])


def test_alerts_do_not_depend_on_the_triggers(spark, tmp_path):
    whole = run(spark, f"{tmp_path}/one", VOYAGE, 1)
    assert run(spark, f"{tmp_path}/many", VOYAGE, 5) == whole
    alerts, last = whole
    # Half an hour into either long stay; the short last one is no stay yet.
    assert [a[2] for a in alerts] == [(T0 + 30 * 60) * US, (T0 + (90 + 30) * 60) * US]
    assert last["underway"] and last["stationary_since_us"] is None


def test_a_short_move_does_not_end_a_stay(spark, tmp_path):
    quay = minutes([(20, 0.0, 0.0), (3, 0.6, 0.00005), (40, 0.0, 0.0)])
    alerts, last = run(spark, f"{tmp_path}/quay", quay, 1)
    assert last["stationary_since_us"] == T0 * US and not last["underway"]
    assert [a[2] for a in alerts] == [(T0 + 30 * 60) * US]


def test_state_sample_by_sample():
    boat, params = live.Boat(), TripParams()
    assert boat.fix(T0 * US, 52.0, 4.9, 0.0, params) and not boat.in_harbour(1800, 600)
    assert not boat.fix((T0 - 60) * US, 52.0, 4.9, 0.0, params) and boat.dropped == 1
    assert boat.fix((T0 - 90000) * US, 52.0, 4.9, 0.0, params) and boat.resets == 1
    boat.engine((T0 - 90000) * US, 5.0)
    assert boat.running() and boat.off_since() is None
    assert boat.fix((T0 - 90000 + 1900) * US, 52.0, 4.9, 0.0, params) and boat.in_harbour(1800, 600)


class Spool:
    """A map state in memory."""

    def __init__(self):
        self.held, self.most = {}, 0

    def updateValue(self, key, value):  # noqa: N802
        self.held[key] = value
        self.most = max(self.most, len(self.held))

    def getValue(self, key):  # noqa: N802
        return self.held[key]

    def removeKey(self, key):  # noqa: N802
        del self.held[key]


def test_a_backlog_is_taken_slice_by_slice():
    """A season in one trigger, in shuffled batches: in order, and never more rows at once than a slice has."""
    seen = []

    class Kept(InOrder):
        def take(self, key, rows):
            seen.append(rows["seq"].tolist())
            return iter(())

    kept = Kept(1000)
    kept.spool = Spool()
    order = np.random.default_rng(4).permutation(50_000)
    batches = (pd.DataFrame({"seq": order[i : i + 700], "v": 1.0, "t": None}) for i in range(0, len(order), 700))
    assert list(kept.handleInputRows((1,), batches, None)) == []
    assert [s for part in seen for s in part] == list(range(50_000)) and max(map(len, seen)) <= 1000
    assert not kept.spool.held and kept.spool.most > 0
    seen.clear()
    list(kept.handleInputRows((1,), iter([pd.DataFrame({"seq": [3, 1, 2]})]), None))
    assert seen == [[1, 2, 3]] and list(kept.handleInputRows((1,), iter(()), None)) == []


def test_a_backlog_in_small_batches_gives_the_same_alerts(spark, tmp_path, monkeypatch):
    want = run(spark, f"{tmp_path}/plain", VOYAGE, 1)
    monkeypatch.setattr(live, "SLICE", 7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "5")
    try:
        assert run(spark, f"{tmp_path}/slices", VOYAGE, 2) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
