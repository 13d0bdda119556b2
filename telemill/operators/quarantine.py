"""Failed messages: rows of the quarantine table and records of a dead-letter topic."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill import fixed
from telemill.functions.ids import uuid_text
from telemill.functions.sql import lookup, quoted
from telemill.functions.times import truncate_second
from telemill.operators.plan import copies
from telemill.operators.transform import FAILURES, TransformConfig, _by_check


def error_text(field: str, expected: str, got: str, reason: str, detail: str) -> str:
    """Error text in the common form, as SQL; the arguments are expressions."""
    form = "field '%s': expected %s, got %s, because of %s; detailed error: \n %s"
    return f"format_string({quoted(form)}, {field}, {expected}, {got}, {reason}, {detail})"


def failure_error(config: TransformConfig) -> Column:
    """Error text of a failed message."""
    message, payload, types = quoted("DeviceMessage"), quoted("NormalizedData"), quoted("DataTypes")
    payload_name = config.registry.attribute("payload_name")
    unsupported = f"unsupported domain: %s (supported: [{' '.join(config.allow_list)}])"

    def reason(check: str) -> str:
        return quoted(FAILURES[check].reason)

    texts = {
        "malformed": error_text("'msg'", message, message, reason("malformed"), "'record is not a JSON message'"),
        "unsupported_domain": error_text(
            "'domain'", types, types, reason("unsupported_domain"), f"format_string({quoted(unsupported)}, domain)"
        ),
        "unknown_data_type": quoted(fixed.UNKNOWN_DATA_TYPE),
        "metrics_missing": error_text("'target'", payload, "'null'", reason("metrics_missing"), "'metrics are missing'"),
        "payload_type": error_text(
            "'target'", payload, payload, reason("payload_type"), f"concat('metrics do not fit ', {payload_name})"
        ),
        "payload_rules": error_text(
            config.registry.attribute("payload_label"), payload_name, payload_name, reason("payload_rules"),
            "concat('broken rules: ', concat_ws(', ', violations))",
        ),
    }
    for missing in (fixed.MISSING_DEVICE_ID, fixed.MISSING_TYPE, fixed.MISSING_TIMESTAMP):
        texts[missing] = error_text("'msg'", message, message, reason(missing), quoted(missing))
    return F.expr(lookup("failed_check", texts))


# What is needed to rebuild and to replay a message.
MESSAGE_COLUMNS = ("type", "device_id", "message_time", "metrics", "raw_value", "record_key")


def message_json() -> Column:
    """The decoded message as JSON text."""
    parts = "named_struct('device_id', device_id, 'type', type, 'timestamp', message_time, 'metrics', parse_json(metrics))"
    return F.expr(f"to_json({parts}, map('ignoreNullFields', 'false'))")


def failure_rows(classified: DataFrame, batch_id: str, config: TransformConfig | None = None) -> DataFrame:
    """Messages that failed before the store, as quarantine rows.

    The raw value is kept next to the error so that the row can be replayed. Identifiers derive from
    the batch and the record's position: repeating a batch repeats them.
    """
    config = config or TransformConfig()
    return classified.where(F.col("failed_check").isNotNull()).select(
        _failure_id(batch_id, F.col("stage")),
        # The process stage never had a message.
        F.when(F.col("stage") == fixed.STAGE_PROCESS, F.lit("")).otherwise(message_json()).alias("message"),
        failure_error(config).alias("error"),
        truncate_second(F.col("arrived_at")).alias("created_at"),
        _by_check("error_type").alias("error_type"),
        _by_check("reason").alias("reason"),
        "raw_value",
        "topic",
        "partition",
        "offset",
        F.lit(batch_id).alias("batch_id"),
        F.to_date("arrived_at").alias("created_date"),
        "stage",
    )


def _failure_id(batch_id: str, stage: Column) -> Column:
    position = [F.col(c) for c in ("topic", "partition", "offset")]
    return uuid_text(F.lit(batch_id), *position, stage, F.col("record_key")).alias("id")


def with_unique_ids(failed: DataFrame, kept: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Give every further row of one id an id of its own.

    A position that a batch holds several times fails several times. Among its rows, the first copy of
    the text with the smallest digest keeps the id; the others add their digest and copy number. Equal
    rows are counted, not ranked, so no task sees all copies of a hot position, and repeating the batch
    repeats the ids. Only ids are shuffled to find the repeated ones; ``kept`` computes these at once, so
    that Spark knows how few they are before it joins the rows.
    """
    repeated = failed.groupBy("id").agg(F.count("*").alias("_rows")).where("_rows > 1").select("id")
    if kept is not None:
        repeated = kept(repeated, "repeated-ids")
        if repeated.isEmpty():
            return failed
    content = F.md5(F.to_json(F.struct(*[c for c in failed.columns if c != "id"])))
    marked = failed.join(repeated, "id", "left_semi").withColumn("_content", content)
    first = marked.groupBy("id").agg(F.min("_content").alias("_first"))
    counted = marked.groupBy(*marked.columns).agg(F.count("*").alias("_n")).join(first, "id")
    told_apart = copies(counted, "_n").withColumn(
        "id",
        F.when((F.col("copy") == 0) & (F.col("_content") == F.col("_first")), F.col("id")).otherwise(
            uuid_text(F.col("id"), F.col("_content"), F.col("copy"))
        ),
    )
    return failed.join(repeated, "id", "left_anti").select(*failed.columns).unionByName(told_apart.select(*failed.columns))


def conflict_rows(conflicts: DataFrame, batch_id: str) -> DataFrame:
    """Events refused by the key check, as quarantine rows of stage ``store``.

    ``conflicts`` are events that still carry the ``MESSAGE_COLUMNS`` they came from.
    """
    failure = FAILURES["already_stored"]
    return conflicts.select(
        _failure_id(batch_id, F.lit(failure.stage)),
        message_json().alias("message"),
        F.expr(
            error_text(
                "'msg'", "'DeviceMessage'", "'DeviceMessage'", quoted(failure.reason),
                "concat('event_id ', event_id, ' is stored already')",
            )
        ).alias("error"),
        truncate_second(F.col("ingested_at")).alias("created_at"),
        F.lit(failure.error_type).alias("error_type"),
        F.lit(failure.reason).alias("reason"),
        "raw_value",
        "topic",
        "partition",
        "offset",
        F.lit(batch_id).alias("batch_id"),
        F.to_date("ingested_at").alias("created_date"),
        F.lit(failure.stage).alias("stage"),
    )


def dlq_records(failed: DataFrame) -> DataFrame:
    """Quarantine rows as dead-letter records: key is the stage, absent parts are left out."""
    message = F.from_json(
        F.nullif(F.col("message"), F.lit("")),
        "device_id string, type string, timestamp string, metrics variant",
    )
    value = F.to_json(
        F.struct("stage", message.alias("message"), F.nullif(F.col("error"), F.lit("")).alias("error"))
    )
    return failed.select(F.col("stage").alias("key"), value.alias("value"))
