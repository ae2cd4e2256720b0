"""Schemas at the edges, and the columns of the derived tables."""

from __future__ import annotations

MESSAGE = "sensor_id string, label string, timestamp string, value double, is_simulated boolean, push_time string"
ENVELOPE = "key string, value string, topic string, partition int, offset bigint, timestamp timestamp"
HISTORY = "timestamp string, value double"
PRICE = "id bigint, station_code string, price_type string, price string, created_at string, updated_at string"
# Names of the change log's columns, by position.
CDC_COLUMNS = ["id", "station_code", "price_type", "price", "created_at", "updated_at"]
_CDC_ROW = "struct<" + ", ".join(f"UNKNOWN_COL{i}: string" for i in range(len(CDC_COLUMNS))) + ">"
CHANGE_LOG = f"schema string, `table` string, type string, log_file string, log_pos bigint, timestamp bigint, rows array<struct<values: {_CDC_ROW}, before_values: {_CDC_ROW}, after_values: {_CDC_ROW}>>"

# Columns of the unified hourly table.
HOURLY_KEYS = ["station_id", "system_type", "equipment_id", "stat_hour"]
HOURLY_METRICS = [
    "avg_supply_temp", "max_supply_temp", "min_supply_temp", "avg_return_temp", "avg_pressure", "max_pressure", "min_pressure", "avg_flow", "max_flow", "min_flow",
    "avg_power", "max_power", "min_power", "energy_consumption_kwh", "energy_input_kwh", "cooling_capacity_kw", "supply_kwh", "cooling_supply_kwh", "heating_supply_kwh", "electric_supply_kwh",
    "runtime_hours", "cumulative_runtime_hours", "start_count",
]
HOURLY_DOUBLES = [*HOURLY_METRICS, "run_minutes", "operation_rate"]
_REST = ["running_sample_count", "run_minutes", "operation_rate", "record_count", "supply_price_type", "metric_quality", "dt", "created_at", "updated_at"]
HOURLY = HOURLY_KEYS + HOURLY_METRICS + _REST
