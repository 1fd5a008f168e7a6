"""Tables that are committed together: replay after a crash, conflicts, imports that are all or nothing, increments against a rebuild, scenarios."""

import pytest
from pyspark.sql import functions as F

from tickwarden.operators import importer, ingest, projection
from tickwarden.operators.events import FIELDS
from tickwarden.sources.snapshots import Conflict, Store, batch_sink

RAW = "ingest_seq long, point_id string, value string, quality string, overridden string"
POINTS = "point_id string, equipment_id string, point_name string, display_name string, point_type string, data_type string, unit string, source_system string, description string, protocol string, address string"
REGISTERS = "row_number long, device_name string, slave_id string, function_code string, register_address string, point_name string, data_type string, scale string, unit string, description string"


def at():
    return F.lit("2024-02-01 00:00:00").cast("timestamp_ntz")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def store_of(spark, tmp_path, points=("P1", "P2", "P3")):
    store = Store(spark, str(tmp_path / "store"))
    tx = store.begin()
    tx.replace("points", spark.createDataFrame([(p, f"E{p}", p, "", "sensor", "analog", "kW", "", "", "", "") for p in points], POINTS), "point_id")
    tx.replace("equipment", spark.createDataFrame([("E1", "UPS", "room", "High", "EPMS", "")], "equipment string, equipment_type string, location string, criticality string, source_system string, notes string"), "equipment")
    tx.replace("alarm_events", spark.createDataFrame([], f"id string, {', '.join(f'{f} ' + ('timestamp_ntz' if f == 'event_timestamp' else 'string') for f in FIELDS)}"))
    tx.commit()
    return store


def test_changes_come_together(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    one = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    tx = store.begin()
    tx.upsert("now", one, "k", buckets=4)
    tx.append("log", one)
    assert store.versions() == [] and tx.table("now").count() == 2  # nobody else sees it
    assert tx.commit() == 1
    tx = store.begin()
    tx.upsert("now", spark.createDataFrame([("b", 3), ("c", 4), (None, 5)], "k string, v int"), "k", buckets=4)
    tx.append("log", one.select("k"))
    assert tx.commit() == 2 and rows(store.table("now"), "v") == [(1,), (3,), (4,), (5,)] and store.table("log").count() == 4
    assert rows(store.table("now", version=1), "v") == [(1,), (2,)]
    tx = store.begin()
    tx.insert_missing("now", spark.createDataFrame([("a", 9), ("d", 9), ("d", 9), (None, 9)], "k string, v int"), "k")
    tx.compact("log")
    tx.commit()
    assert rows(store.table("now"), "v") == [(1,), (3,), (4,), (5,), (9,)] and store.table("log").count() == 4
    assert store.begin().commit() == 3  # nothing changed
    with pytest.raises(ValueError, match="unknown columns"):
        store.begin().append("log", one.withColumn("x", F.lit(1)))
    assert store.vacuum(keep=1) > 0 and store.versions() == [3] and store.table("now").count() == 5


def test_the_second_of_two_writers_changes_nothing(spark, tmp_path):
    store = store_of(spark, tmp_path)
    a, b = store.begin(), store.begin()
    for tx, v in ((a, 1), (b, 2)):
        tx.append("log", spark.createDataFrame([(v,)], "v int"))
    a.commit()
    with pytest.raises(Conflict):
        b.commit()
    assert rows(store.table("log"), "v") == [(1,)]


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    store = store_of(spark, tmp_path)
    fails = [True]

    def apply(tx, batch):
        ingest.ingest_increment(tx, batch, at())
        if fails and fails.pop():
            raise RuntimeError("lost before the commit")

    sink = batch_sink(store.root, "samples", apply)
    first = spark.createDataFrame([(1, "P1", "5", "GOOD", None), (2, "P9", "5", None, None)], RAW)
    with pytest.raises(RuntimeError):
        sink(first, 0)
    assert store.versions() == [1]
    for _ in range(2):  # as after a crash between the commit and the stream's own mark
        sink(first, 0)
    assert store.versions() == [1, 2] and store.table("point_samples").count() == 1 and rows(store.table("failed_samples"), "index", "error") == [(2, "Point not found: P9")]
    sink(spark.createDataFrame([(3, "P1", "6", "BAD", "true")], RAW), 1)
    assert rows(store.table("current_point_values"), "point_id", "value", "quality") == [("P1", "6", "BAD")]
    assert rows(store.table("alarm_events"), "event_type", "previous_state", "new_state", "equipment_id", "details_json") == [
        ("POINT_OVERRIDE_CHANGED", "False", "True", "EP1", '{"changed_field":"overridden","new_value":true,"old_value":false}'),
        ("POINT_QUALITY_CHANGED", "GOOD", "BAD", "EP1", '{"changed_field":"quality","new_value":"BAD","old_value":"GOOD"}'),
    ]


def test_a_stream_into_the_store(spark, tmp_path):
    store = store_of(spark, tmp_path)
    raw = [(i, f"P{i % 4}", str(i), ["GOOD", "BAD", None][i % 3], ["", "yes", None][i % 3]) for i in range(60)]
    for i in range(3):
        spark.createDataFrame(raw[i * 20 : i * 20 + 20], RAW).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds its marks gone: all batches come again
        stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        sink = batch_sink(store.root, "samples", lambda tx, batch: ingest.ingest_increment(tx, batch, at()))
        stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / f"marks{_}")).trigger(availableNow=True).start().awaitTermination(120)
    checked = ingest.checked_samples(spark.createDataFrame(raw, RAW), store.table("points"), at())
    good, bad = ingest.split_checked(checked)
    assert rows(store.table("point_samples"), *good.columns) == rows(good, *good.columns)
    assert rows(store.table("failed_samples"), *bad.columns) == rows(bad, *bad.columns)
    assert rows(store.table("current_point_values"), "point_id", "sample_id") == rows(projection.latest(good), "point_id", "sample_id")
    whole = projection.health_events(good, store.table("points"))
    assert rows(store.table("alarm_events"), *FIELDS[1:]) == rows(whole, *FIELDS[1:]) and whole.count() > 40


def test_an_import_is_all_or_nothing(spark, tmp_path):
    store = store_of(spark, tmp_path)
    good, bad = ("ups 1", "1", "3", "10", "load kw", "float", "1", "kW", "d"), ("ups 1", "999", "3", "11", "other", "float", "1", "", "d")
    normal = lambda *files: importer.normalised(spark.createDataFrame([(i + 2, *f) for i, f in enumerate(files)], REGISTERS))
    out = importer.commit_import(store.begin(), normal(good, bad), at(), "a.csv")
    assert (out["committed"], out["error_count"], out["would_create_point_count"], store.versions()) == (False, 1, 1, [1])
    tx, other = store.begin(), store.begin()
    other.append("alarm_events", store.table("alarm_events"))
    other.append("notes", spark.range(1))
    other.commit()
    with pytest.raises(Conflict):  # the catalog that the file was validated against is not the last one any more
        importer.commit_import(tx, normal(good), at(), "a.csv")
    assert store.table("points").count() == 3
    out = importer.commit_import(store.begin(), normal(good), at(), "a.csv")
    assert out["committed"] and rows(store.table("points").where("protocol = 'modbus'"), "point_id", "address") == [("UPS-1_LOAD_KW", "slave_id=1;function_code=3;register_address=10")]
    event = store.table("alarm_events").first()
    assert (event["point_id"], event["equipment_id"], event["event_type"], event["generated_alarm_id"]) == ("UPS-1_LOAD_KW", "UPS-1", "MODBUS_IMPORT_COMMITTED", None)
    assert event["details_json"] == '{"created_equipment_count":1,"created_point_count":1,"csv_path":"a.csv","row_count":1,"skipped_row_count":0,"updated_point_count":0}'
    assert rows(store.table("equipment").where("equipment = 'UPS-1'"), "notes") == [("Imported from static Modbus register map",)]
    again = importer.commit_import(store.begin(), normal(good), at(), "a.csv")
    assert (again["committed"], again["would_skip_point_count"], again["warning_count"]) == (True, 1, 1) and store.table("points").count() == 4


def test_a_scenario_is_all_or_nothing(spark, tmp_path):
    store = store_of(spark, tmp_path)
    tx = store.begin()
    ingest.ingest_increment(tx, spark.createDataFrame([(1, "P1", "5", "BAD", "true")], RAW), at())
    tx.commit()
    updates = spark.createDataFrame([("s1", 1, "P1", "7"), ("s1", 2, "P2", "8"), ("s2", 1, "P1", "9"), ("s2", 2, "P9", "9"), ("s2", 3, "P8", "9"), ("s3", 1, "P1", "6")], "scenario_id string, position long, point_id string, value string")
    now = ingest.with_scenarios(store.table("current_point_values"), updates, store.table("points"), at())
    assert rows(now, "point_id", "value", "quality", "overridden", "source", "from_scenario") == [("P1", "6", "GOOD", False, "SCENARIO", True), ("P2", "8", "GOOD", False, "SCENARIO", True)]
    tx = store.begin()
    refused = ingest.apply_scenario(tx, updates.where("scenario_id <> 's3'"), at())
    assert rows(refused, "scenario_id", "error") == [("s2", "Point not found: P9")]
    tx.commit()
    assert rows(store.table("current_point_values"), "point_id", "value") == [("P1", "7"), ("P2", "8")]


def test_a_sweep_tells_of_a_sample_once(spark, tmp_path):
    store = store_of(spark, tmp_path)
    tx = store.begin()
    raw = spark.createDataFrame([(1, "P1", "5", "GOOD", "30"), (2, "P2", "5", "STALE", "90000000"), (3, "P3", "5", "GOOD", "90000000")], "ingest_seq long, point_id string, value string, quality string, stale_after_seconds string")
    ingest.ingest_increment(tx, raw, at())
    tx.commit()
    for time in ("2024-02-01 00:00:30", "2024-02-01 00:00:31", "2024-02-01 00:01:00"):
        tx = store.begin()
        ingest.health_sweep(tx, F.lit(time).cast("timestamp_ntz"))
        tx.commit()
    events = store.table("alarm_events").orderBy("point_id").collect()
    assert [(e["point_id"], str(e["event_timestamp"]), e["message"], e["new_state"]) for e in events] == [("P1", "2024-02-01 00:00:31", "Point sample is stale: P1", "Stale"), ("P2", "2024-02-01 00:00:30", "Point sample is stale: P2", "Stale")]
    assert events[0]["details_json"] == '{"evaluation_timestamp":"2024-02-01 00:00:31","quality":"GOOD","received_timestamp":"2024-02-01 00:00:00","source":"SIMULATED","source_timestamp":"2024-02-01 00:00:00","stale_after_seconds":30}'


def test_a_reset_keeps_the_catalog(spark, tmp_path):
    store = store_of(spark, tmp_path)
    tx = store.begin()
    ingest.ingest_increment(tx, spark.createDataFrame([(1, "P1", "5", "BAD", "true"), (2, "P1", "5", "GOOD", "no"), (3, "P9", "", None, None)], RAW), at())
    tx.commit()
    seed = store.table("point_samples").where("ingest_seq = 1")
    tx = store.begin()
    ingest.reset(tx, seed)
    tx.commit()
    assert {n: store.table(n).count() for n in ("point_samples", "current_point_values", "alarm_events", "failed_samples", "points")} == {"point_samples": 1, "current_point_values": 1, "alarm_events": 0, "failed_samples": 0, "points": 3}
