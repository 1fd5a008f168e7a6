"""The lifecycle against a sequential model, in batch with any chunk length and as a stream."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickwarden.operators import lifecycle
from tickwarden.streaming.lifecycle import lifecycle_sink, step, streaming_transitions

SCHEMA = "rule_id string, ts timestamp_ntz, seq long, status string, clears boolean, delay_seconds long"
START = datetime(2024, 1, 1)


def histories(seed, rules=30, rows=60):
    rng, out, seq = random.Random(seed), [], 0
    for k in range(rules):
        at, delay = START, rng.choice([0, 300, 3600, 20_000])
        for _ in range(rng.randint(1, rows)):
            at += timedelta(seconds=rng.choice([0, 1, 299, 300, 3600, 50_000]))
            status = rng.choice(["Triggered", "Triggered", "Normal", "BAD_QUALITY", "Disabled"])
            clears = status == "Disabled" or (status == "Normal" and rng.random() < 0.5)
            if rng.random() < 0.3:  # the rule is edited
                delay = rng.choice([0, 300, 3600, 20_000])
            out.append((f"R{k}", at, seq, status, clears, delay))
            seq += 1
    return out


def sequential(rows):
    """(previous state, state, episode) of each row, one after another."""
    out, kept = {}, {}
    for rule, at, seq, status, clears, delay in sorted(rows, key=lambda x: (x[0], x[1], x[2])):
        state, since, episode = kept.get(rule, ("NONE", float("nan"), 0))
        now, since = step(state, since, status == "Triggered", clears, (at - START).total_seconds(), delay)
        episode += state == "NONE" and now != "NONE"
        out[rule, seq] = (state, now, episode)
        kept[rule] = (now, since, episode)
    return out


@pytest.mark.parametrize("seed, segment_rows", [(1, 1), (2, 4), (3, 25), (4, 10**9)])
def test_windows_are_the_sequential_model(spark, seed, segment_rows):
    rows = histories(seed)
    got = lifecycle.alarm_states(spark.createDataFrame(rows, SCHEMA), segment_rows).collect()
    assert {(r["rule_id"], r["seq"]): (r["previous_state"], r["state"], r["episode"]) for r in got} == sequential(rows)


def test_a_longer_delay_does_not_undo_an_alarm(spark):
    rows = [("R", START + timedelta(seconds=i), i, "Triggered", False, d) for i, d in enumerate([0, 600, 600])]
    for segment_rows in (1, 86_400):
        got = lifecycle.alarm_states(spark.createDataFrame(rows, SCHEMA), segment_rows).orderBy("seq").collect()
        assert [r["state"] for r in got] == ["ACTIVE"] * 3


def test_golden_trace(spark):
    values = [("Normal", True), ("Triggered", False), ("Triggered", False), ("Normal", False), ("Normal", True), ("BAD_QUALITY", False)]
    minutes = [0, 1, 7, 8, 9, 10]
    rows = [("R", START + timedelta(minutes=m), i, s, c, 300) for i, (m, (s, c)) in enumerate(zip(minutes, values))]
    states = lifecycle.alarm_states(spark.createDataFrame(rows, SCHEMA))
    assert [r["state"] for r in states.orderBy("ts").collect()] == ["NONE", "PENDING", "ACTIVE", "ACTIVE", "NONE", "NONE"]
    events = [(r["event_type"], r["event_previous_state"], r["event_new_state"]) for r in lifecycle.transitions(states).orderBy("ts").collect()]
    assert events == [("PENDING_CREATED", "", "PENDING"), ("ALARM_ACTIVATED", "PENDING", "ACTIVE"), ("ALARM_CLEARED", "ACTIVE", "CLEARED")]
    alarm = lifecycle.episodes(states, {"first_status": F.col("status")}).first()
    assert (alarm["state"], alarm["episode"], alarm["first_status"]) == ("CLEARED", 1, "Triggered")


def test_a_rule_of_one_day_is_split_over_tasks(spark):
    """A rule with all rows, all of one second: no segment has much more than its share."""
    rows = [("R", START, i, "Triggered" if i % 5 else "Normal", i % 5 == 0, 0) for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    states = lifecycle.alarm_states(df, 100)
    assert {(r["rule_id"], r["seq"]): (r["previous_state"], r["state"], r["episode"]) for r in states.collect()} == sequential(rows)
    plan = states._jdf.queryExecution().optimizedPlan().toString()
    assert "__segment" in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = states._jdf.queryExecution().executedPlan().toString().splitlines()
        cut = [below for line, below in zip(lines, lines[1:]) if "Exchange hashpartitioning(rule_id" in line and "__segment" not in line and "Reused" not in line]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert cut  # by the rule alone: rows of short rules, and one row for each segment


def test_segments_have_a_bounded_number_of_rows(spark, monkeypatch, tmp_path):
    rows = [("R", START, i, "Normal", False, 0) for i in range(5000)] + [(f"S{i % 50}", START, i, "Normal", False, 0) for i in range(500)]
    monkeypatch.setattr(lifecycle, "shared_path", lambda spark, name: str(tmp_path / name))
    lifecycle.alarm_states(spark.createDataFrame(rows, SCHEMA).repartition(4), 250).count()
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "segments")).groupBy("__segment").count().collect()]
    assert len(sizes) >= 15 and max(sizes) <= 1000 and sum(sizes) == 5000  # short rules are not cut


def test_time_may_go_back_in_another_order(spark):
    """In the order of steps, a step's time may be earlier than that of the one before; no delay means at once."""
    rows = [("R", START + timedelta(seconds=s), i, "Triggered", False, d) for i, (s, d) in enumerate([(600, 300), (0, 300), (899, 300), (900, 300), (100, 300)])] + [("S", START + timedelta(seconds=s), i, "Triggered", False, d) for i, (s, d) in enumerate([(600, 300), (0, 0)])]
    for segment_rows in (1, 2, 100):
        got = lifecycle.alarm_states(spark.createDataFrame(rows, SCHEMA), segment_rows, ("seq",)).orderBy("rule_id", "seq").collect()
        assert [r["state"] for r in got] == ["PENDING", "PENDING", "PENDING", "ACTIVE", "ACTIVE", "PENDING", "ACTIVE"]


def test_acknowledge_and_orphans(spark):
    alarms = spark.createDataFrame([("R1", 1, "ACTIVE"), ("R2", 1, "PENDING"), ("R3", 1, "CLEARED")], "rule_id string, episode long, state string")
    commands = spark.createDataFrame([("R1", 1, START + timedelta(hours=2), "bo"), ("R1", 1, START + timedelta(hours=1), " ")], "rule_id string, episode long, acknowledged_at timestamp_ntz, operator string")
    got = {r["rule_id"]: (r["acknowledged"], r["acknowledged_by"]) for r in lifecycle.acknowledge(alarms, commands).collect()}
    assert got == {"R1": (True, "bo"), "R2": (False, ""), "R3": (False, "")}  # the last command stays
    facts = alarms.selectExpr("*", "'P1' AS point_id", "'E1' AS equipment_id", "'5' AS triggered_value", "'hot' AS alarm_message")
    current = spark.createDataFrame([("P1", "PS-1")], "point_id string, sample_id string")
    events = lifecycle.acknowledge_events(facts, commands.unionByName(commands.limit(1).selectExpr("'R9' AS rule_id", "episode", "acknowledged_at", "operator")), current).orderBy("event_timestamp").collect()
    assert [(e["rule_id"], e["acknowledged_by"], e["previous_state"], e["new_state"], e["value"], e["sample_id"], e["message"], e["details_json"]) for e in events] == [
        ("R1", "local-operator", "ACTIVE", "ACTIVE", "5", "PS-1", "hot", '{"acknowledged_by":"local-operator"}'),
        ("R1", "bo", "ACTIVE", "ACTIVE", "5", "PS-1", "hot", '{"acknowledged_by":"bo"}'),
    ]  # an event each; the command on an alarm that is not there makes none
    gone = lifecycle.orphaned(alarms, spark.createDataFrame([("R1",)], "rule_id string")).collect()
    assert [(r["rule_id"], r["state"], r["evaluation_note"]) for r in gone] == [("R2", "CLEARED", "Rule not evaluated")]


def test_first_open_alarm(spark):
    rows = [("R", 1, "PENDING", "2024-01-03"), ("R", 2, "ACTIVE", "2024-01-01"), ("R", 3, "ACTIVE", "2024-01-02"), ("R", 4, "CLEARED", "2024-01-09"), ("S", 7, "PENDING", "2024-01-01"), ("S", 8, "PENDING", "2024-01-02")]
    got = lifecycle.first_open(spark.createDataFrame(rows, "rule_id string, episode long, state string, last_evaluated_at string")).collect()
    assert sorted((r["rule_id"], r["episode"], r["state"]) for r in got) == [("R", 3, "ACTIVE"), ("S", 8, "PENDING")]


COLUMNS = ["rule_id", "seq", "episode", "event_type", "event_previous_state", "event_new_state"]


def hot_histories(seed):
    """Histories in which one rule has a third of all rows, and a last row that no rule waits for."""
    rows, rng = histories(seed, 12, 20), random.Random(seed)
    seq, at = len(rows), START
    for _ in range(len(rows) // 2):
        at += timedelta(seconds=rng.choice([1, 299, 300, 3600]))
        status = rng.choice(["Triggered", "Triggered", "Normal", "BAD_QUALITY"])
        rows.append(("HOT", at, seq, status, status == "Normal" and rng.random() < 0.5, 300))
        seq += 1
    return rows


def written(spark, rows, path, parts):
    for i in range(parts):
        spark.createDataFrame(rows[i * len(rows) // parts : (i + 1) * len(rows) // parts], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def streamed(df, tmp_path, name):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return sorted(tuple(r) for r in df.sparkSession.table(name).select(COLUMNS).collect()), q


def wanted(spark, rows):
    return sorted(map(tuple, lifecycle.transitions(lifecycle.alarm_states(spark.createDataFrame(rows, SCHEMA))).select(COLUMNS).collect()))


def test_shuffled_stream_is_batch(spark, tmp_path):
    rows = hot_histories(7)
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    end = ("END", START + timedelta(days=4000), 10**6, "Normal", False, 0)
    got, _ = streamed(streaming_transitions(written(spark, [*mixed, end], str(tmp_path / "in"), 3), "1000 days"), tmp_path, "shuffled")
    assert got == wanted(spark, rows)


def test_stream_goes_on_from_a_batch(spark, tmp_path):
    rows = sorted(hot_histories(8), key=lambda r: (r[1], r[2]))
    half = len(rows) // 2
    states = lifecycle.alarm_states(spark.createDataFrame(rows[:half], SCHEMA))
    end = ("END", START + timedelta(days=4000), 10**6, "Normal", False, 0)
    late = ("HOT", START - timedelta(days=1), -1, "Triggered", False, 0)  # the watermark has passed it when it comes
    stream = written(spark, [*rows[half:], end], str(tmp_path / "in"), 2)
    spark.createDataFrame([late], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got, q = streamed(streaming_transitions(stream, "0 seconds", lifecycle.end_states(states)), tmp_path, "goes_on")
    assert got == sorted(set(wanted(spark, rows)) - set(wanted(spark, rows[:half])))
    assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) == 1


@pytest.mark.parametrize("segment_rows", [5, 10**6])
def test_committed_stream_is_batch(spark, tmp_path, segment_rows):
    from tickwarden.sources.snapshots import Store

    rows = sorted(hot_histories(9), key=lambda r: (r[1], r[2]))
    stream = written(spark, rows, str(tmp_path / "in"), 3)
    store = Store(spark, str(tmp_path / "store"))
    q = stream.writeStream.foreachBatch(lifecycle_sink(store.root, segment_rows=segment_rows)).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert sorted(tuple(r) for r in store.table("alarm_transitions").select(COLUMNS).collect()) == wanted(spark, rows)
    assert store.manifest().batches == {"alarms": 2}


def test_stale_stream_is_the_sweeps(spark, tmp_path):
    from tickwarden.operators import ingest, projection
    from tickwarden.streaming.health import streaming_stale_points

    rng, schema = random.Random(4), "point_id string, ingest_seq long, ts timestamp_ntz, quality string, received_timestamp timestamp_ntz, source_timestamp timestamp_ntz, stale_after_seconds long"
    rows = []
    for i in range(150):
        at = START + timedelta(seconds=max(0, i * 11_400 + rng.randrange(-200_000, 10_000, 600)))  # some arrive late
        rows.append((f"P{rng.choice([0, 0, 1, 2, 3])}", i, at, rng.choice(["GOOD", "BAD", "STALE", "GOOD"]), None if i % 9 == 0 else at, at, rng.choice([0, 3600, 43_200, 200_000])))
    last = START + timedelta(days=20)
    df = spark.createDataFrame(rows, schema)
    points = df.select("point_id").distinct()
    seen = projection.as_of_ticks(df, points, F.lit(START).cast("timestamp_ntz"), F.lit(last).cast("timestamp_ntz"), 43_200).where("sample is not null").select("tick", "sample.*")
    want = sorted((r["point_id"], r["ingest_seq"], r["tick"]) for r in ingest.first_stale(ingest.stale_points(seen, F.col("tick"))).collect())
    for part in (rows[:50], rows[50:100], [*rows[100:], ("END", 10**6, START + timedelta(days=4000), "GOOD", None, START, 10**9)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streaming_stale_points(stream, str(START), 43_200, "1000 days").writeStream.format("memory").queryName("stale").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = sorted((r["point_id"], r["ingest_seq"], r["tick"]) for r in spark.table("stale").collect() if r["tick"] <= last)
    assert got == want and len(want) > 30
