"""Columns of the seed files and the tables that they become."""

from __future__ import annotations

from pyspark.sql import types as T

#: Required columns of each seed file, in order.
HEADERS = {
    "equipment": "equipment equipment_type location criticality source_system notes",
    "points": "id equipment_id point_name display_name point_type data_type unit normal_min normal_max source_system description created_at updated_at",
    "alarm_rules": "id point_id rule_name rule_type operator threshold_value clear_value severity alarm_message enabled delay_seconds created_at updated_at",
    "current_point_values": "id point_id value quality source updated_at",
    "replay_samples": "sequence point_id value quality source_timestamp source protocol address stale_after_seconds overridden out_of_service",
    "register_map": "device_name slave_id function_code register_address point_name data_type scale unit description",
    "alarms": "timestamp source equipment equipment_type alarm severity status",
    "facility_scenarios": "id name status risk_level start_time end_time operating_mode incident_commander summary operator_goal",
    "alarm_correlations": "id scenario_id title status confidence window_start window_end primary_equipment impacted_equipment root_cause_hypothesis explanation recommended_focus",
    "alarm_correlation_members": "id correlation_id alarm_rule_id point_id equipment_id contribution evidence",
    "incident_timeline": "id scenario_id event_timestamp event_type equipment_id title description source actor severity",
    "shift_turnover": "id shift_date shift_name outgoing_operator incoming_operator facility_state watch_items open_actions turnover_risk",
    "equipment_out_of_service": "id equipment_id status oos_type started_at expected_return_at returned_at reason operational_impact mitigation approved_by",
    "corrective_actions": "id scenario_id equipment_id action_type priority status owner due_at completed_at description verification",
    "procedure_references": "id scenario_id procedure_type procedure_code title applicability reference_step owner location",
    "reliability_reports": "id period_start period_end generated_at availability_percent critical_alarm_count warning_alarm_count mttr_minutes oos_hours corrective_actions_open corrective_actions_closed nuisance_alarm_count executive_summary",
}
HEADERS = {name: tuple(columns.split()) for name, columns in HEADERS.items()}

SAMPLES = T.StructType(
    [
        T.StructField("ingest_seq", T.LongType()),
        T.StructField("point_id", T.StringType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("value", T.StringType()),
        T.StructField("quality", T.StringType()),
        T.StructField("overridden", T.BooleanType()),
        T.StructField("out_of_service", T.BooleanType()),
        T.StructField("stale_after_seconds", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("received_timestamp", T.TimestampNTZType()),
        T.StructField("source_timestamp", T.TimestampNTZType()),
    ]
)
