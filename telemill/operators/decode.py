"""Record bytes to message columns, strictly."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.times import parse_rfc3339, utc
from telemill.operators.plan import evaluate_once

# Every field arrives as a VARIANT: one parse of the text keeps the JSON type of each value, so a
# number in a text field can be told from text.
_ENVELOPE = "array<struct<device_id variant, type variant, timestamp variant, metrics variant>>"
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def header_map(headers: Column) -> Column:
    """Header list to a map of text; the last of equal keys wins."""
    last = F.filter(
        headers,
        lambda h, i: ~F.exists(F.slice(headers, i + 2, F.size(headers)), lambda later: later["key"] == h["key"]),
    )
    pairs = F.transform(last, lambda h: F.struct(h["key"].alias("key"), h["value"].cast("string").alias("value")))
    return F.coalesce(F.map_from_entries(pairs), F.create_map().cast("map<string,string>"))


def decode(messages: DataFrame) -> DataFrame:
    """Kafka-shaped records to decoded messages, one row each, nothing dropped.

    Added columns: ``device_id``, ``type``, ``message_time`` (text as sent), ``occurred_at``,
    ``metrics`` (JSON text, NULL when absent or null), ``is_malformed``. ``record_key`` is the wide part
    of the position of replayed records, NULL for those of a topic.
    """
    source = messages.select(
        "topic",
        "partition",
        "offset",
        utc(F.col("timestamp")).alias("arrived_at"),
        F.col("value").cast("string").alias("raw_value"),
        (F.col("record_key") if "record_key" in messages.columns else F.lit(None).cast("string")).alias("record_key"),
        *(["headers"] if "headers" in messages.columns else []),
    )
    # Wrapping as an array element catches what a plain parse lets through: text after the value,
    # a second value, an empty record.
    wrapped = F.expr("concat('[', raw_value, ',null]')")
    parsed = source.withColumn("_parsed", F.from_json(wrapped, _ENVELOPE, _STRICT))

    def body(field: str) -> str:
        return f"get(_parsed, 0).{field}"

    def kind(field: str) -> str:
        """JSON type of a field; VOID when it is absent or null."""
        return f"coalesce(schema_of_variant({body(field)}), 'VOID')"

    texts = {"device_id": "device_id", "type": "type", "timestamp": "message_time"}
    kept = [f"`{c}`" for c in source.columns]
    fields = parsed.selectExpr(
        *kept,
        "size(_parsed) = 2 AS _one",
        *[f"{kind(f)} AS _kind_{f}" for f in texts],
        *[f"try_variant_get({body(f)}, '$', 'string') AS _{f}" for f in texts],
        # JSON text shows the type of the value by its first character.
        f"nullif(to_json({body('metrics')}), 'null') AS metrics",
        r"btrim(raw_value, ' \t\r\n') AS _trimmed",
    )
    one_value = "_one AND ((startswith(_trimmed, '{') AND endswith(_trimmed, '}')) OR _trimmed = 'null')"
    text_or_nothing = " AND ".join(f"_kind_{f} IN ('STRING', 'VOID')" for f in texts)
    object_or_nothing = "coalesce(startswith(metrics, '{'), true)"
    checked = fields.selectExpr(
        *kept,
        *[f"CASE WHEN _kind_{f} = 'STRING' THEN _{f} ELSE '' END AS {c}" for f, c in texts.items()],
        "metrics",
        f"coalesce({one_value}, false) AND {text_or_nothing} AND {object_or_nothing} AS _typed",
        "_kind_timestamp = 'VOID' AS _no_time",
    ).withColumn("occurred_at", parse_rfc3339(F.col("message_time")))
    decoded = checked.selectExpr(
        *kept,
        "device_id",
        "type",
        "message_time",
        "occurred_at",
        "metrics",
        "NOT _typed OR (NOT _no_time AND occurred_at IS NULL) AS is_malformed",
    )
    return evaluate_once(decoded, ["device_id", "type", "message_time", "occurred_at", "metrics", "is_malformed"])
