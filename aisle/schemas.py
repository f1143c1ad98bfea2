"""Types of the fact and dimension tables the operators read, as DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of each relation.
TABLES = {
    "stores": """
        id BIGINT, code STRING, name STRING, region STRING, city STRING, district STRING, area_sqm DOUBLE,
        store_type STRING, is_active BOOLEAN
    """,
    "sales": """
        store_id BIGINT, sale_date DATE, receipt_no STRING, item_id STRING, item_name STRING, category STRING,
        brand STRING, quantity DOUBLE, unit_price DOUBLE, total_amount DOUBLE, discount_amount DOUBLE, member_id BIGINT,
        channel STRING
    """,
    "inventory": """
        store_id BIGINT, item_id STRING, item_name STRING, category STRING, quantity DOUBLE, unit_cost DOUBLE,
        total_value DOUBLE, snapshot_date DATE, min_stock DOUBLE, max_stock DOUBLE, status STRING
    """,
    "traffic": """
        store_id BIGINT, traffic_date DATE, hour INT, enter_count INT, exit_count INT, pass_by_count INT,
        conversion_rate DOUBLE
    """,
    "weather": """
        city STRING, weather_date DATE, condition STRING, temp_high DOUBLE, temp_low DOUBLE, humidity DOUBLE,
        wind_speed DOUBLE, precipitation DOUBLE, aqi INT
    """,
    "promotions": """
        id BIGINT, store_id BIGINT, promo_code STRING, name STRING, promo_type STRING, start_date DATE, end_date DATE,
        discount_rate DOUBLE, discount_amount DOUBLE, target_category STRING, target_items STRING, status STRING
    """,
    "members": """
        id BIGINT, member_no STRING, name STRING, phone STRING, gender STRING, birthday DATE, register_date DATE,
        register_store_id BIGINT, level STRING, total_points INT, tags ARRAY<STRING>, rfm_segment STRING,
        is_active BOOLEAN
    """,
    "member_transactions": """
        id BIGINT, member_id BIGINT, store_id BIGINT, transaction_date TIMESTAMP, amount DOUBLE, receipt_no STRING
    """,
    "products": """
        id BIGINT, item_id STRING, item_name STRING, category STRING, brand STRING, unit_cost DOUBLE, launch_date DATE,
        is_active BOOLEAN
    """,
    "association_rules": """
        store_id BIGINT, antecedent ARRAY<STRING>, consequent ARRAY<STRING>, support DOUBLE, confidence DOUBLE,
        lift DOUBLE, conviction DOUBLE, leverage DOUBLE, transaction_count BIGINT, period_start STRING,
        period_end STRING, category_filter STRING
    """,
    "market_signals": """
        id BIGINT, signal_type STRING, signal_date DATE, region STRING, category STRING, value DOUBLE, raw_value DOUBLE,
        source STRING, confidence DOUBLE
    """,
    "energy_readings": """
        id BIGINT, store_id BIGINT, equipment_id BIGINT, reading_time TIMESTAMP, power_kw DOUBLE, energy_kwh DOUBLE,
        operational_state STRING
    """,
    "container_events": """
        event_id BIGINT, container_id BIGINT, event_type STRING, event_time TIMESTAMP, location STRING,
        equipment_id BIGINT, operator_id BIGINT
    """,
}


def schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])


def load_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Stored relation with its declared types; date partitions prune by filter, absent columns are null."""
    return spark.read.schema(schema(name)).parquet(f"{directory.rstrip('/')}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Rows in the declared columns, order and types of a relation: absent columns and values that do not cast are null."""
    have = {c.lower() for c in df.columns}
    fields = schema(name).fields
    return df.select(
        *[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields]
    )
