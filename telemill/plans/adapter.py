"""Device messages derived from the given tables, one message per row of the table."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telemill.functions.sql import quoted
from telemill.functions.times import format_rfc3339

TOPIC = "ingestion.raw"
ORDERS_TOPIC = "ingestion.orders"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``events`` table as message fields, before they become JSON."""
    source = _table(spark, sf_dir, "events").selectExpr(
        "event_id AS n",
        "ts",
        "user_id",
        "value AS v",
        "CAST(get_json_object(props, '$.k') AS BIGINT) AS k",
        """CASE event_type WHEN 'click' THEN 'energy_meter' WHEN 'purchase' THEN 'financial_stream'
           WHEN 'view' THEN 'temperature_sensor' WHEN 'signup' THEN 'climate_sensor'
           WHEN 'error' THEN 'power_meter' END AS type""",
    )
    energy = "CASE WHEN type = 'energy_meter' THEN {} END"
    finance = "CASE WHEN type = 'financial_stream' THEN {} END"
    climate = "CASE WHEN type IN ('temperature_sensor', 'climate_sensor') THEN {} END"
    metrics = {
        "power_w": energy.format("CASE WHEN k % 5 = 0 THEN -v WHEN k % 5 <> 1 THEN v * 10 END"),
        "energy_wh": energy.format("v * 100"),
        "voltage_v": energy.format("CAST(200 + k * 4 AS FLOAT)"),
        "current_ma": energy.format("CAST(k * 10 AS FLOAT)"),
        "amount_minor": finance.format("round(v * 100)"),
        "currency": finance.format("CASE WHEN k % 3 = 0 THEN ' usd ' ELSE 'EUR' END"),
        "merchant": finance.format("concat('  m', k, ' ')"),
        "status": finance.format(
            "CASE k % 4 WHEN 0 THEN 'COMPLETED' WHEN 1 THEN ' pending' WHEN 2 THEN 'Failed' ELSE 'approved' END"
        ),
        "temperature_c": climate.format("v - 60"),
        "humidity_percent": climate.format("v - 5"),
        "air_quality_index": climate.format("v * 2"),
        "data": "CASE WHEN type = 'power_meter' THEN named_struct('k', k) END",
    }
    return source.selectExpr(
        "n",
        f"'{TOPIC}' AS topic",
        "CAST(n % 4 AS INT) AS partition",
        "n AS offset",
        "CASE WHEN n % 97 = 0 THEN '' ELSE concat('dev-', user_id) END AS device_id",
        "type",
        "ts AS occurred_at",
        "ts + make_dt_interval(0, 0, 0, n % 300) AS arrived_at",
        f"named_struct({', '.join(f'{quoted(k)}, {v}' for k, v in metrics.items())}) AS metrics",
    )


def _records(fields: DataFrame, value: Column | None = None) -> DataFrame:
    """Message fields as Kafka-shaped records."""
    body = F.to_json(
        F.struct("device_id", "type", format_rfc3339(F.col("occurred_at")).alias("timestamp"), "metrics")
    )
    return fields.withColumn("_body", body).select(
        "topic",
        "partition",
        "offset",
        F.to_timestamp(format_rfc3339(F.col("arrived_at"))).alias("timestamp"),
        F.col("device_id").alias("key"),
        (F.col("_body") if value is None else value).alias("value"),
        F.expr(
            """array(named_struct('key', 'trace', 'value', CAST(offset AS STRING)),
                     named_struct('key', 'zone', 'value', CAST(partition AS STRING)),
                     named_struct('key', 'trace', 'value', 'retry'))"""
        ).alias("headers"),
    )


def device_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``events`` as a device message."""
    return _records(event_fields(spark, sf_dir))


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``orders`` as a transaction on a second topic."""
    orders = _table(spark, sf_dir, "orders")
    status = (
        F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("failed")
    )
    fields = orders.select(
        F.lit(ORDERS_TOPIC).alias("topic"),
        (F.col("o_orderkey") % 4).cast("int").alias("partition"),
        F.col("o_orderkey").alias("offset"),
        F.concat(F.lit("cust-"), F.col("o_custkey")).alias("device_id"),
        F.lit("financial_stream").alias("type"),
        F.col("o_orderdate").alias("occurred_at"),
        F.col("o_orderdate").alias("arrived_at"),
        F.struct(
            F.round(F.col("o_totalprice") * 100).alias("amount_minor"),
            F.lit("usd").alias("currency"),
            F.col("o_orderpriority").alias("merchant"),
            status.alias("status"),
        ).alias("metrics"),
    )
    return _records(fields)


# How records are spoiled, by ``n % 16``; the rest stay as they are.
SPOILED = {
    0: "truncated",
    1: "trailing text",
    2: "array",
    3: "numeric device_id",
    4: "metrics array",
    5: "bad timestamp",
    6: "two values",
    7: "null",
    8: "empty",
}


def spoiled_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The device messages with transport damage on part of the records."""
    body = F.col("_body")
    kinds = {
        0: F.substring(body, 1, 20),
        1: F.concat(body, F.lit(" junk")),
        2: F.concat(F.lit("["), body, F.lit("]")),
        3: F.regexp_replace(body, '"device_id":"[^"]*"', '"device_id":5'),
        4: F.lit('{"device_id":"d","type":"energy_meter","timestamp":"2024-01-01T00:00:00Z","metrics":[1]}'),
        5: F.regexp_replace(body, '"timestamp":"[^"]*"', '"timestamp":"nope"'),
        6: F.concat(body, F.lit(","), body),
        7: F.lit("null"),
        8: F.lit(""),
    }
    slot = F.col("offset") % 16
    value = F.coalesce(*[F.when(slot == i, v) for i, v in kinds.items()], body)
    return _records(event_fields(spark, sf_dir), value)
