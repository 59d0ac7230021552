"""Closed table contracts: exact columns, types, nullability and a total order of rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns by table, as name and type; a question mark allows nulls.
COLUMNS = {
    "anomaly_observation": "observation_id string, anomaly_id string, station_id string, report_date date, raw_row_report_date date, available_at timestamp, unit string, station_name string?, longitude double?, latitude double?, discipline string, measurement string?, instrument_or_method string?, observation_period string?, forecast_efficacy string?, trend_time date?, start_time timestamp_ntz, reported_end_time timestamp_ntz?, end_flag string, report_state string, anomaly_type string?, anomaly_description string?, annual_anomaly string?, r_value string?, r0_value string?, term_class string?, is_listed boolean, right_censored boolean, identity_complete boolean, reliability_flags array<string>, source_id string, source_file string, source_sha256 string, source_sheet string, source_row bigint, source_serial_number bigint, source_period_year bigint, source_period bigint",
    "anomaly_entity_audit": "audit_id string, audit_type string, status string, source_file string?, source_sheet string?, report_date date?, anomaly_ids array<string>, observation_ids array<string>, reliability_flags array<string>, previous_reported_end_time timestamp_ntz?, current_reported_end_time timestamp_ntz?",
    "anomaly_report_period": "report_id string, source_id string, source_file string, source_sha256 string, report_year bigint, report_period bigint, report_date date, available_at timestamp, row_count bigint, row_report_date_mismatch_count bigint, row_report_date_before_count bigint, row_report_date_after_count bigint, deformation_row_count bigint, fluid_row_count bigint, electromagnetic_row_count bigint, cross_fault_row_count bigint",
    "fault_point_raw": "fault_point_id string, fault_id bigint, segment_number bigint, point_number bigint, longitude double, latitude double, is_new_in_source_version boolean, fault_name_raw string, segment_name_raw string, source_file string, source_row bigint, source_available_at timestamp, historical_model_eligible boolean, quality_flags array<string>",
    "fault_segment": "fault_segment_id string, fault_id bigint, segment_number bigint, fault_name_raw string, segment_name_raw string, simplified_geometry_wkb binary, raw_point_count bigint, geometry_point_count bigint, is_new_in_source_version boolean, strike_deg double, dip_deg double, slip_angle_deg double, geologic_total_rate_mm_per_year double?, geologic_strike_slip_rate_mm_per_year double?, geologic_dip_slip_rate_mm_per_year double?, geodetic_total_rate_mm_per_year double?, geodetic_strike_slip_rate_mm_per_year double?, geodetic_strike_slip_error_mm_per_year double?, geodetic_dip_slip_rate_mm_per_year double?, geodetic_dip_slip_error_mm_per_year double?, recurrence_period_years double?, recurrence_reliability bigint?, last_strong_earthquake_year_raw bigint?, last_strong_earthquake_reliability bigint?, elapsed_ratio_at_snapshot double?, rupture_gap_weight double, locking_weight double, microseismic_sparsity_weight double, coulomb_stress_weight double, long_term_hazard_score double, missing_fields array<string>, geometry_flags array<string>, attribute_source_file string, hazard_source_file string, source_available_at timestamp, historical_model_eligible boolean, true_trace_id string?, true_trace_mapping_status string, true_trace_match_confidence string",
    "fault_trace": "trace_id string, source_segment_number bigint, trace_name_raw string?, trace_name_normalized string?, geometry_wkb binary?, raw_point_count bigint, geometry_point_count bigint, is_closed boolean, usable_for_geometry boolean, geometry_hash string, duplicate_group_id string?, duplicate_geometry boolean, duplicate_name_conflict boolean, quality_flags array<string>, source_file string, delimiter_source_line bigint, source_available_at timestamp, historical_model_eligible boolean",
    "basemap_feature": "basemap_feature_id string, role string, source_segment_number bigint, geometry_wkb binary, raw_point_count bigint, geometry_point_count bigint, is_closed boolean, geometry_hash string, duplicate_group_id string?, duplicate_geometry boolean, quality_flags array<string>, source_file string, delimiter_source_line bigint, source_comments array<string>, source_available_at timestamp, model_feature_eligible boolean",
    "fault_trace_crosswalk_audit": "crosswalk_candidate_id string, fault_segment_id string, trace_id string, fault_name_raw string, trace_name_raw string, name_match_method string, status string, match_confidence string, trace_duplicate_group_id string?, trace_duplicate_name_conflict boolean, historical_model_eligible boolean",
    "earthquake_event": "event_id string, origin_time_utc timestamp, available_at timestamp, origin_time_local timestamp_ntz, longitude double, latitude double, depth_km double?, magnitude double, magnitude_type string?, place string?, catalog_sources array<string>, inside_study_area boolean, dedup_confidence string, anchor_source_record_id string, quality_flags array<string>",
    "earthquake_source_record": "source_record_id string, duplicate_group_id string, source_id string, source_file string, source_file_sha256 string, source_row bigint, raw_record_sha256 string, origin_time_raw string, origin_time_local timestamp_ntz, origin_time_utc timestamp, available_at timestamp, longitude_raw string, latitude_raw string, depth_raw string, magnitude_raw string, longitude double, latitude double, depth_km double?, magnitude double, magnitude_type string?, place_raw string?, place string?, fixed_field_raw string?, inside_study_area boolean, normalization_flags array<string>",
    "earthquake_dedup_candidate": "candidate_id string, m3_group_id string, m5_group_id string, m3_source_record_ids array<string>, m5_source_record_ids array<string>, time_delta_seconds double, distance_km double, magnitude_delta double, exact_match boolean, auto_eligible boolean, m3_auto_degree bigint, m5_auto_degree bigint, decision string, merged_event_id string?",
    "integration_grid": "cell_size_km double, cell_id string, row bigint, column bigint, representative_x_km double, representative_y_km double, clipped_area_km2 double",
    "representative_intensity": "cell_id string, row bigint, column bigint, representative_x_km double, representative_y_km double, clipped_area_km2 double, background_intensity double, triggering_intensity double, total_intensity double",
    "future_ensemble": "record_kind string, issue_date_local string, issue_id string, horizon_days int, replicate_index smallint?, replicate_count int?, cell_size_km double?, cell_id string?, expected_count double?",
}
#: The total order of each table.
ORDER = {
    "anomaly_observation": "report_date, source_file, source_sheet, source_row, observation_id",
    "anomaly_entity_audit": "audit_type, audit_id",
    "anomaly_report_period": "report_date, source_file",
    "fault_point_raw": "fault_id, segment_number, point_number",
    "fault_segment": "fault_id, segment_number",
    "fault_trace": "source_segment_number, trace_id",
    "basemap_feature": "role, source_file, source_segment_number, basemap_feature_id",
    "fault_trace_crosswalk_audit": "fault_segment_id, trace_id, crosswalk_candidate_id",
    "earthquake_event": "origin_time_utc, event_id",
    "earthquake_source_record": "source_id, source_row, source_record_id",
    "earthquake_dedup_candidate": "time_delta_seconds, distance_km, magnitude_delta, candidate_id",
    "integration_grid": "cell_size_km, row, column",
    "representative_intensity": "row, column",
    "future_ensemble": "issue_date_local, horizon_days, record_kind, replicate_index, cell_size_km, cell_id",
}


def fields(name: str) -> list[tuple[str, str, bool]]:
    """Column, type and whether it may be null."""
    out = []
    for part in COLUMNS[name].split(", "):
        column, kind = part.split(" ", 1)
        out.append((column, kind.rstrip("?"), kind.endswith("?")))
    return out


def order(name: str) -> list[str]:
    return ORDER[name].split(", ")


def conform(df: DataFrame, name: str) -> DataFrame:
    """df with exactly the contract's columns, cast; raises where names are missing or left over."""
    wanted = [c for c, _, _ in fields(name)]
    missing, extra = sorted(set(wanted) - set(df.columns)), sorted(set(df.columns) - set(wanted))
    if missing or extra:
        raise ValueError(f"{name}: missing {missing}, not in the contract {extra}")
    return df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c, kind, _ in fields(name)])


def null_faults(df: DataFrame, name: str) -> DataFrame:
    """column and nulls of those that must have none: one aggregate over one scan."""
    strict = [c for c, _, nullable in fields(name) if not nullable]
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in strict])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in strict])).alias("x")).select("x.*").filter("nulls > 0")


def document(name: str) -> str:
    """The contract as JSON with sorted keys."""
    return json.dumps({"dataset": name, "fields": [{"name": c, "type": k, "nullable": n} for c, k, n in fields(name)], "sort_keys": order(name)}, sort_keys=True, indent=2)


def matches(schema: StructType, name: str) -> bool:
    return [(f.name, f.dataType.simpleString()) for f in schema] == [(c, k) for c, k, _ in fields(name)]
