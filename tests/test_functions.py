"""Column functions against plain Python."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from telemill import fixed
from telemill.functions import (
    InvalidCursor, clamp_limit, cursor_column, decode_cursor, is_semver, is_uuid, parse_rfc3339,
    trim_space, truncate_bytes,
)
from telemill.operators.redact import plain_number, redact


def column(spark, values, kind="string"):
    return spark.createDataFrame([(v,) for v in values], f"c {kind}")


def apply(spark, values, function, kind="string"):
    return [r[0] for r in column(spark, values, kind).coalesce(1).select(function(F.col("c"))).collect()]


def cut(text, limit):
    data = text.encode()
    if len(data) <= limit:
        return text
    return data[:limit].decode(errors="ignore") + fixed.TRUNCATED_SUFFIX


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 7, 16])
def test_truncate_bytes_never_splits_a_character(spark, limit):
    rng = random.Random(limit)
    texts = ["", "a", "é", "€", "😀", "�" * 9] + [
        "".join(rng.choice("aé€😀� ") for _ in range(rng.randrange(12))) for _ in range(200)
    ]
    assert apply(spark, texts, lambda c: truncate_bytes(c, limit)) == [cut(t, limit) for t in texts]


def test_trim_space_takes_all_white_space(spark):
    texts = [f"{w}a{w}b{w}" for w in fixed.WHITESPACE] + ["​x​", "", " "]
    expected = [f"a{w}b" for w in fixed.WHITESPACE] + ["​x​", "", ""]
    assert apply(spark, texts, trim_space) == expected


def test_rfc3339(spark):
    cases = {
        "2024-01-05T14:35:22Z": datetime(2024, 1, 5, 14, 35, 22),
        "2024-01-05T14:35:22.123456789Z": datetime(2024, 1, 5, 14, 35, 22, 123456),
        "2024-01-05T14:35:22.5+23:30": datetime(2024, 1, 4, 15, 5, 22, 500000),
        "2024-01-05T14:35:22-05:00": datetime(2024, 1, 5, 19, 35, 22),
        "2024-02-30T00:00:00Z": None,
        "2024-01-05T24:00:00Z": None,
        "2024-01-05T14:35:22+24:00": None,
        "2024-01-05T14:35:22": None,
        "2024-01-05 14:35:22Z": None,
        "2024-01-05t14:35:22Z": None,
        "2024-01-05T14:35:22,5Z": None,
        "2024-01-05T14:35:22Z\n": None,
        "2024-01-05": None,
        "": None,
    }
    assert apply(spark, list(cases), parse_rfc3339) == list(cases.values())


def test_semver_and_uuid(spark):
    good = ["1.0.0", "0.0.4", "1.2.3-rc.1+build.5"]
    bad = ["1.0", "01.0.0", "1.0.0-", "v1.0.0", "", "1.0.0\n"]
    assert apply(spark, good + bad, is_semver) == [True] * 3 + [False] * 6
    ids = ["2fc90fdb-c970-4410-4468-49090d752b2c", "2fc90fdbc970441044684909 0d752b2c", None]
    assert apply(spark, ids, is_uuid) == [True, False, False]


def test_cursor_round_trip(spark):
    at = datetime(2024, 1, 5, 1, 2, 3, 450000)
    frame = spark.createDataFrame([(at, "id-1")], "t timestamp_ntz, i string")
    token = frame.select(cursor_column(F.col("t"), F.col("i"))).first()[0]
    assert "=" not in token
    position = decode_cursor(token)
    assert (position.ingested_at, position.event_id) == (at, "id-1")


@pytest.mark.parametrize("token", ["not-valid-base64!!", "abc", "e30", "bm90IGpzb24", "eyJ0IjoxfQ", "e30="])
def test_bad_cursor(token):
    with pytest.raises(InvalidCursor, match="invalid cursor"):
        decode_cursor(token)


def test_page_size():
    assert [clamp_limit(v) for v in (None, -1, 0, 1, 20, 100, 101)] == [20, 20, 20, 1, 20, 100, 100]


def test_plain_number(spark):
    assert apply(spark, [1599.0, 0.5, 1e10, -2.25, 100.0, 0.0], plain_number, "double") == [
        "1599", "0.5", "10000000000", "-2.25", "100", "0",
    ]
    assert apply(spark, [1e30, 1e-13, -1.25e-7, 12345678.901, 1.5e300, None], plain_number, "double") == [
        "1" + "0" * 30, "0.0000000000001", "-0.000000125", "12345678.901", "15" + "0" * 299, None,
    ]


def test_redact_at_any_depth(spark):
    frame = spark.sql(
        """select 1 as token, 'x' as Token, named_struct('secret', 5, 'ok', 'y', 'in', named_struct('password', array(1))) as g,
           array(named_struct('secret', 's', 'ok', 1)) as list, map('token', 't', 'a', 'b') as m,
           map('secret', 1, 'n', 2) as counts, cast(null as struct<secret: string>) as gone"""
        .replace("'x' as Token", "'x' as `Tokens`")
    )
    row = redact(frame).first()
    assert row["token"] == fixed.REDACTED and row["Tokens"] == "x"
    assert row["g"].secret == fixed.REDACTED and row["g"].ok == "y" and row["g"]["in"].password == fixed.REDACTED
    assert row["list"][0].secret == fixed.REDACTED and row["list"][0].ok == 1
    assert row["m"] == {"token": fixed.REDACTED, "a": "b"}
    assert row["counts"] == {"secret": fixed.REDACTED, "n": "2"}
    assert row["gone"] is None


def test_redact_inside_nested_lists_and_maps_of_any_key(spark):
    frame = spark.sql(
        """select array(array(named_struct('password', 'p', 'ok', 'y'))) as lists,
           map(7, named_struct('secret', 's', 'ok', 1)) as by_number,
           array(map('token', array(1), 'n', array(2))) as maps, map(1, array(map('token', 't'))) as deep"""
    )
    row = redact(frame).first()
    assert row["lists"][0][0].password == fixed.REDACTED and row["lists"][0][0].ok == "y"
    assert row["by_number"][7].secret == fixed.REDACTED and row["by_number"][7].ok == 1
    assert row["maps"] == [{"token": fixed.REDACTED, "n": "[2]"}]
    assert row["deep"] == {1: [{"token": fixed.REDACTED}]}
