"""Readers, writers, ingest, importer commit, catalog updates and the briefing on small files."""

import pytest
from pyspark.sql import functions as F

from tickwarden.operators import catalog, importer, ingest, projection
from tickwarden.sources import briefing, files
from tickwarden.sources.csvfiles import csv_files, csv_stream
from tickwarden.sources.schemas import HEADERS


def write(path, header, *rows):
    path.write_text("\n".join([",".join(header), *rows]) + "\n")
    return str(path)


def test_header_is_checked(spark, tmp_path):
    path = write(tmp_path / "a.csv", ["equipment", "location"], "a,b")
    with pytest.raises(files.HeaderError, match="criticality, equipment_type, notes, source_system"):
        files.read_csv(spark, path, HEADERS["equipment"])


def test_surplus_cells_are_refused(spark, tmp_path):
    path = write(tmp_path / "a.csv", HEADERS["equipment"], "a,b,c,d,e,f", "a,b,c,d,e,f,g")
    with pytest.raises(files.SurplusCells, match="Row 3"):
        files.checked(files.read_csv(spark, path, HEADERS["equipment"]))


def test_files_with_issues(spark, tmp_path):
    columns = list(HEADERS["register_map"])
    good = write(tmp_path / "a.csv", [f'"{columns[0]}"', *columns[1:]], '"ups\n1",1,3,10,load,float,1,kW,"a ""b"", c"', "", "ups 2,1,3,11,load", "ups 3,1,3,12,load,float,1,kW,d,e")
    lacks = write(tmp_path / "b.csv", [c for c in columns if c not in ("scale", "unit")], "x")
    rows, issues = files.read_register_maps(spark, [good, lacks, str(tmp_path / "none.csv")])
    assert sorted((r["field"], r["message"], r["row_number"]) for r in issues.collect()) == [("csv_path", f"CSV file not found: {tmp_path}/none.csv", None), ("header", "Missing required CSV columns: scale, unit", None)]
    got = {r["row_number"]: r for r in rows.collect()}
    assert sorted(got) == [2, 3, 4] and got[2]["device_name"] == "ups\n1" and got[2]["description"] == 'a "b", c' and got[3]["scale"] is None
    seen = csv_files(spark, [good, good], tuple(columns)).where("row_number = 4")
    assert [r["issue_field"] for r in seen.collect()] == ["row", "row"] and seen.first()["issue_message"] == f"Unexpected extra CSV columns in {good} row 4: ['e']"
    assert csv_files(spark, [good, good, good], tuple(columns)).rdd.getNumPartitions() == 3


def test_files_as_a_stream(spark, tmp_path):
    for n in (1, 2):
        write(tmp_path / f"{n}.csv", ["sequence", "v"], f"{n},a", f"{n},b")
    got = []
    for _ in range(2):
        q = csv_stream(spark, str(tmp_path), ("sequence", "v")).writeStream.foreachBatch(lambda df, i: got.extend((r["sequence"], r["row_number"], r["v"]) for r in df.collect())).option("checkpointLocation", str(tmp_path / "marks")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        write(tmp_path / "3.csv", ["v", "sequence"], "c,3")  # comes after the first run
    assert sorted(got) == [("1", 2, "a"), ("1", 3, "b"), ("2", 2, "a"), ("2", 3, "b"), ("3", 2, "c")]


def test_seeds_are_all_or_none(spark, tmp_path):
    write(tmp_path / "points.csv", HEADERS["points"], "P1,E1,n,d,sensor,analog,kW,,n/a,BMS,x,a,b")
    write(tmp_path / "values.csv", HEADERS["current_point_values"], "C1,P1,5,unknown,SIMULATED,2024-01-01 00:00", "C2,P9,6,,SIMULATED,")
    write(tmp_path / "bad.csv", HEADERS["equipment"], "a,b,c,d,e,f,g")
    from tickwarden.sources.snapshots import Store

    seeds, out = {"points": "points.csv", "current_point_values": "values.csv"}, str(tmp_path / "store")
    tx = Store(spark, out).begin()
    tx.append("alarm_events", spark.createDataFrame([("AE",)], "id string"))
    tx.commit()
    with pytest.raises(files.SurplusCells):
        files.load_seeds(spark, str(tmp_path), {**seeds, "equipment": "bad.csv"}, out)
    assert Store(spark, out).versions() == [1]
    at = F.lit("2024-02-01").cast("timestamp_ntz")
    assert files.load_seeds(spark, str(tmp_path), seeds, out, at) == {"points": 1, "current_point_values": 2}
    store = Store(spark, out)
    assert store.table("alarm_events").count() == 0
    got = {r["point_id"]: (r["unit"], r["quality"], str(r["source_timestamp"]), r["created_by"], r["stale_after_seconds"]) for r in store.table("point_samples").collect()}
    assert got == {"P1": ("kW", "UNCERTAIN", "2024-01-01 00:00:00", "loader", 300), "P9": ("", "UNCERTAIN", "2024-02-01 00:00:00", "loader", 300)}


def test_typed_seed_and_load(spark, tmp_path):
    write(tmp_path / "rules.csv", HEADERS["alarm_rules"], "R1,P1,n,Analog_Limit,>,1,null,Critical,m,yes,5,x,y")
    row = files.read_seed(spark, str(tmp_path / "rules.csv"), "alarm_rules").first()
    assert (row["clear_value"], row["enabled"], row["delay_seconds"], row["rule_type"]) == ("", True, 5, "analog_limit")
    assert files.load_seeds(spark, str(tmp_path), {"alarm_rules": "rules.csv"}, str(tmp_path / "out")) == {"alarm_rules": 1}


def test_replay_order_and_defaults(spark, tmp_path):
    rows = [f"{s},P1,{i},,2024-01-01 00:00,,,,,{'on' if i == 0 else 'junk'}," for i, s in enumerate(["10", "b", "2", "a", "2"])]
    path = write(tmp_path / "r.csv", HEADERS["replay_samples"], *rows)
    got = files.read_replay(spark, path).collect()
    assert [(r["sequence"], r["value"]) for r in got] == [("2", "2"), ("2", "4"), ("10", "0"), ("a", "3"), ("b", "1")]
    assert (got[0]["quality"], got[0]["source"], got[0]["protocol"], got[2]["overridden"], got[0]["overridden"]) == ("GOOD", "SIMULATED", "CSV_REPLAY", True, False)
    assert files.read_replay(spark, path, "2").count() == 2
    with pytest.raises(ValueError):
        files.read_replay(spark, path, " ")


def test_upsert_and_ignore(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int")
    assert sorted(map(tuple, files.upsert(old, new, "k").collect())) == [("a", 1), ("b", 3), ("c", 4)]
    assert [tuple(r) for r in files.insert_or_ignore(old, new, "k").collect()] == [("c", 4)]
    assert files.simulated_samples(spark, "2024-01-01 00:00:00").count() == 3


def test_ingest_isolates_failures(spark):
    points = spark.createDataFrame([("P1", "kW")], "point_id string, unit string")
    raw = spark.createDataFrame(
        [(1, "P1", "5", None, None, "", "", "", "", ""), (2, "P9", "5", None, None, "", "", "", "", ""), (3, "P1", "5", None, None, "", "-1", "", "", ""), (4, "P1", "5", None, None, "", "", "maybe", "", "")],
        "ingest_seq long, point_id string, value string, quality string, source string, unit string, stale_after_seconds string, overridden string, out_of_service string, source_timestamp string",
    )
    good, bad = ingest.split_checked(ingest.checked_samples(raw, points, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")))
    row = good.first()
    assert (good.count(), row["unit"], row["quality"], row["stale_after_seconds"], row["source"]) == (1, "kW", "GOOD", 300, "SIMULATED")
    assert {r["index"]: r["error"] for r in bad.collect()} == {2: "Point not found: P9", 3: "delay_seconds must be a non-negative integer", 4: "overridden must be a boolean value"}


def test_arrival_order_wins(spark):
    rows = [("P", 1, "2024-01-02", "late"), ("P", 2, "2024-01-01", "early")]
    df = spark.createDataFrame(rows, "point_id string, ingest_seq long, d string, value string").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    assert projection.latest(df).first()["value"] == "early"


def test_import_preview_and_commit(spark):
    rows = [(2, "ups 1", "1", "3", "10", "load kw", "float", "1", "kW", "d"), (3, "ups 1", "1", "3", "10", "other", "float", "1", "", "o"), (4, "x", "300", "3", "1", "p", "text", "z", "", ""), (5, "", "1", "1", "1", "p", "bool", "1", "", "")]
    raw = spark.createDataFrame(rows, "row_number long, device_name string, slave_id string, function_code string, register_address string, point_name string, data_type string, scale string, unit string, description string")
    points = spark.createDataFrame([("UPS-1_LOAD_KW", "", "", "", "", "")], "point_id string, unit string, description string, source_system string, protocol string, address string")
    equipment = spark.createDataFrame([], "equipment string")
    done = importer.normalised(raw)
    twice = importer.duplicate_issues(done).collect()
    assert [(r["row_number"], r["field"], r["first_row"]) for r in twice] == [(3, "register_address", 2)]
    s = importer.preview_summary(done, points, equipment).first()
    assert (s["total_rows"], s["parsed_rows"], s["valid_rows"], s["error_count"], s["would_update_point_count"], s["would_create_point_count"]) == (4, 2, 1, 7, 1, 1)
    said = {(r["row_number"], r["message"]) for r in importer.row_errors(done, points, equipment).collect()}
    assert (3, "Duplicate Modbus address tuple in import: slave_id=1, function_code=3, register_address=10 also appears on row 2") in said
    assert (4, "data_type must be one of: analog, bit, bool, boolean, enum, float, float32, float64, int16, int32, integer, uint16, uint32") in said and (5, "Missing required field: description") in said
    new_equipment, new_points, filled = importer.committed(done.where("row_number = 2"), points, equipment, F.lit("2024-01-01").cast("timestamp_ntz"))
    assert new_equipment.first()["equipment"] == "UPS-1" and new_points.count() == 0
    assert (filled.first()["unit"], filled.first()["address"]) == ("kW", "slave_id=1;function_code=3;register_address=10")
    assert done.where("row_number = 2").first()["display_name"] == "UPS-1 Load kW"


RULES = "rule_id string, point_id string, rule_name string, threshold_value string, clear_value string, severity string, alarm_message string, enabled boolean, delay_seconds long"
UPDATES = "rule_id string, threshold_value string, clear_value string, severity string, alarm_message string, enabled string, delay_seconds string"


def test_rule_updates(spark):
    at = F.lit("2024-01-01").cast("timestamp_ntz")
    rules = spark.createDataFrame([("R1", "P1", "n", "1", "", "Info", "m", True, 5)], RULES)
    points = spark.createDataFrame([("P1", "E1")], "point_id string, equipment_id string")
    change = spark.createDataFrame([("R1", " 2 ", None, "info", None, "yes", None)], UPDATES)
    assert [tuple(r) for r in catalog.rule_changes(rules, change).collect()] == [("R1", "threshold_value", "1", "2")]  # Info and yes are what the rule has
    assert catalog.updated_rules(rules, change).first()["threshold_value"] == "2"
    event = catalog.update_events(rules, change, points, at).first()
    assert event["details_json"] == '{"changed_fields":["threshold_value"],"new_values":{"threshold_value":"2"},"old_values":{"threshold_value":"1"}}'
    assert (event["rule_id"], event["equipment_id"], event["message"], event["acknowledged_by"], event["id"][:3]) == ("R1", "E1", "Alarm rule updated: n", "local-operator", "AE-")
    more = spark.createDataFrame([("R1", None, None, None, None, "0", "7")], UPDATES)
    assert catalog.update_events(rules, more, points, at).first()["details_json"] == '{"changed_fields":["delay_seconds","enabled"],"new_values":{"delay_seconds":7,"enabled":false},"old_values":{"delay_seconds":5,"enabled":true}}'
    assert catalog.update_events(rules, change.where("false"), points, at).count() == 0
    bad = [("R1", None, None, "loud", None, None, "-1"), ("R9", None, None, None, None, "on", None), ("R9", "1", None, None, None, None, None), ("R1", "1", None, None, None, None, None)]
    bad = spark.createDataFrame([(*r, i) for i, r in enumerate(bad)], f"{UPDATES}, n int")
    assert [r["error"] for r in catalog.checked_updates(bad, rules).orderBy("n").collect()] == ["delay_seconds must be a non-negative integer", "enabled must be one of: 1, 0, true, false, yes, no", "Alarm rule not found: R9", None]


def test_rule_creation(spark):
    points = spark.createDataFrame([("P1", "E1")], "point_id string, equipment_id string")
    rules = spark.createDataFrame([("R1",)], "rule_id string")
    columns = "rule_id string, point_id string, rule_name string, rule_type string, operator string, threshold_value string, clear_value string, severity string, alarm_message string, enabled string, delay_seconds string, extra array<string>"
    ok = ("R2", "P1", "n", "Analog_Limit", ">", "", "", "critical", "m", "Yes", "", None)
    put = lambda **c: tuple(c.get(f.split()[0], v) for f, v in zip(columns.split(", "), ok))
    rows = [
        ok,
        put(extra=["zone", "tags"], rule_name=""),
        put(rule_name=" ", enabled=None, rule_type="x"),
        put(rule_type="x", operator="~"),
        put(operator="==", severity="x"),
        put(severity="x", enabled="on"),
        put(enabled="on", delay_seconds="x"),
        put(delay_seconds="1.5", rule_id="R1"),
        put(rule_id="R1", point_id="P9"),
        put(point_id="P9"),
    ]
    requests = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], f"{columns}, n int")
    got = [r["error"] for r in catalog.checked_rules(requests, rules, points, "extra").orderBy("n").collect()]
    assert got == [
        None,  # a threshold may be blank
        "Unsupported alarm rule field(s): tags, zone",
        "Missing required alarm rule field(s): rule_name, enabled",
        "rule_type must be one of: analog_limit, boolean_state, enum_match",
        "operator for analog_limit must be one of: <, <=, >, >=",
        "severity must be one of: Critical, Info, Warning",
        "enabled must be one of: 1, 0, true, false, yes, no",
        "delay_seconds must be a non-negative integer",
        "Alarm rule already exists: R1",
        "Point not found: P9",
    ]
    new = catalog.normalised_rules(spark.createDataFrame([ok], columns))
    event = catalog.created_events(new, points, F.lit("2024-01-01").cast("timestamp_ntz")).first()
    assert event["details_json"] == '{"created_rule":{"alarm_message":"m","clear_value":"","delay_seconds":0,"enabled":true,"id":"R2","operator":">","point_id":"P1","rule_name":"n","rule_type":"analog_limit","severity":"Critical","threshold_value":""}}'


LOG = "severity string, source string, equipment string, alarm string, status string, timestamp string"


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.glob("part-*.txt")))


def test_briefing(spark, tmp_path):
    log = spark.createDataFrame([("Critical", "A", "e1", "hot", "Active", "t1"), ("Warning", "A", "e2", "warm", "Cleared", "t2"), ("critical", "B", "e2", "x", "active", "t0")], LOG)
    briefing.write_briefing(log, str(tmp_path / "b"), "Briefing")
    assert text_of(tmp_path / "b").split("\n")[:20] == [
        "# Briefing", "", "## Executive Summary", "", "The alarm log contains 3 total alarm records.", "", "## Alarm Count by Severity", "", "- Critical: 1", "- Warning: 1", "- critical: 1",
        "", "## Alarm Count by Source", "", "- A: 2", "- B: 1", "", "## Most Frequent Equipment in Alarm", "", "- e2: 2",
    ]
    assert "- t1 | A | e1 | hot\n\n## Operator Follow-Up\n" in text_of(tmp_path / "b")
    briefing.write_briefing(log.limit(0), str(tmp_path / "none"))
    assert "contains 0 total" in text_of(tmp_path / "none") and "- No active critical alarms found.\n" in text_of(tmp_path / "none")


def test_briefing_lists_all(spark, tmp_path):
    rows = [("Critical", f"s{i}", f"e{i}", f"a{i}", "Active", f"2026-01-01 00:{i // 60:02}:{i % 60:02}") for i in range(70)]
    briefing.write_briefing(spark.createDataFrame(rows, LOG).repartition(5), str(tmp_path / "b"))
    text = text_of(tmp_path / "b")
    assert all(f"- e{i}: 1\n" in text and f"- s{i}: 1\n" in text and f"| e{i} | a{i}\n" in text for i in range(70))
    listed = [x for x in text.split("\n") if x.startswith("- 2026")]
    assert listed == sorted(listed) and len(listed) == 70


def test_context_read_models(spark):
    from tickwarden.plans import readmodels as m

    equipment = spark.createDataFrame([("E1", "UPS", "room", "High", "EPMS")], "equipment string, equipment_type string, location string, criticality string, source_system string")
    rules = spark.createDataFrame([("R1", "rule", "Critical")], "rule_id string, rule_name string, severity string")
    points = spark.createDataFrame([("P1", "point", "Point")], "point_id string, point_name string, display_name string")
    row = lambda name, **given: spark.createDataFrame([tuple(given.get(c, "") for c in HEADERS[name])], HEADERS[name] and ", ".join(f"{c} string" for c in HEADERS[name]))
    context = {
        "facility_scenarios": row("facility_scenarios", id="S1", start_time="1").unionByName(row("facility_scenarios", id="S2", start_time="2")),
        "alarm_correlations": row("alarm_correlations", id="C1", impacted_equipment="E1; E2").unionByName(row("alarm_correlations", id="C2")),
        "alarm_correlation_members": row("alarm_correlation_members", id="M1", correlation_id="C1", alarm_rule_id="R1", point_id="P9"),
        "incident_timeline": row("incident_timeline", id="T1", equipment_id="OPS"),
        "shift_turnover": row("shift_turnover", id="H1", watch_items="a;;b"),
        "equipment_out_of_service": row("equipment_out_of_service", id="O1", equipment_id="E1"),
        "corrective_actions": row("corrective_actions", id="A1", equipment_id="E1"),
        "procedure_references": row("procedure_references", id="Q1"),
        "reliability_reports": row("reliability_reports", id="L1"),
    }
    got = {k: df.collect() for k, df in m.operations_overview(context, equipment, rules, points).items()}
    assert got["active_scenario"][0]["id"] == "S2"
    nested = {r["id"]: r for r in got["alarm_correlations"]}
    assert (nested["C1"]["members"][0]["rule_name"], nested["C1"]["members"][0]["point_name"], nested["C2"]["members"]) == ("rule", "", [])
    assert nested["C1"]["impacted_equipment_list"] == ["E1", "E2"]
    assert got["incident_timeline"][0]["equipment_type"] == "" and got["equipment_out_of_service"][0]["equipment_type"] == "UPS"
    assert got["shift_turnover"][0]["watch_item_list"] == ["a", "b"]
    alarms = spark.createDataFrame([("R1", "P1", "E9", "CLEARED", "2"), ("R1", "P1", "E1", "ACTIVE", "1")], "rule_id string, point_id string, equipment_id string, state string, last_evaluated_at string")
    shown = m.generated_alarms(alarms, rules, points, equipment).collect()
    assert [(r["state"], r["equipment_type"]) for r in shown] == [("ACTIVE", "UPS"), ("CLEARED", "Unknown")]
    assert [tuple(r) for r in m.operational_counts({"alarms": alarms}).collect()] == [("alarms", 2)] and m.as_json(alarms).count() == 2
