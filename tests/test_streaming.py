import time
from datetime import datetime

from gridmason.streaming import events


def run(spark, tmp_path, make, batches, name, mode="append"):
    source = str(tmp_path / name)
    schema = "property_id long, observed_at timestamp, price double, kind string"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(f"{source}/b{i}")
        time.sleep(1.1)  # files are taken by the second they were written
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
    q = make(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"{name}-cp")).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def at(h, m=0):
    return datetime(2026, 1, 1, h, m)


def test_price_changes(spark, tmp_path):
    got = run(spark, tmp_path, events.price_changes, [[(1, at(1), 5.0, "x"), (1, at(2), 5.0, "x")], [(1, at(3), 6.0, "x"), (2, at(3), None, "x")]], "changes")
    assert sorted((r["property_id"], r["price"], r["previous_price"]) for r in got if r["price"] is not None) == [(1, 5.0, None), (1, 6.0, 5.0)]


def test_unseen(spark, tmp_path):
    got = run(spark, tmp_path, lambda s: events.unseen(s, ["property_id"], "observed_at"), [[(1, at(1), 5.0, "x"), (1, at(2), 6.0, "x")], [(1, at(3), 7.0, "x"), (2, at(3), 1.0, "x")]], "fresh")
    assert sorted(r["property_id"] for r in got) == [1, 2]


def test_windows_drop_late_rows(spark, tmp_path):
    # rows are late by the watermark of the batch before
    batches = [[(1, at(1, 5), 1.0, "x"), (1, at(1, 50), 2.0, "x")], [(1, at(5), 1.0, "x")], [(1, at(6), 1.0, "x")], [(1, at(1, 10), 9.0, "x")], [(1, at(9), 1.0, "x")]]
    got = run(spark, tmp_path, lambda s: events.windowed_counts(s, "observed_at", "kind", "price"), batches, "windows")
    assert {r["start"].hour: (r["n"], r["total"]) for r in got}[1] == (2, 3.0)
