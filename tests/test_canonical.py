"""Canonical JSON and row digests against json.dumps and hashlib."""

import datetime
import hashlib
import json
from decimal import Decimal

import pytest

from skarn.operators.reports import row_digest
from skarn.sources.tables import canonical_json

HARD = [0.1, 1e16, 1e22, 1e-7, 123456789.123456789, -0.0, 5e-324, 1.7976931348623157e308, 100.0, 1 / 3]
SCHEMA = "z double, a struct<y:bigint,b:array<struct<q:string,c:boolean>>>, m map<string,array<double>>, s string, n int"
ROWS = [(x, {"y": 2**62 + i, "b": [{"q": 'é "x" \\ / \n\t\x01   😀', "c": i % 2 == 0}, None, {"q": None, "c": None}]}, {"k": [x, None], "a": []}, "a\u007fb", i) for i, x in enumerate(HARD)]
ROWS += [(None, None, None, None, None), (1.0, {"y": None, "b": []}, {}, "", 0)]
NAMES = ["z", "a", "m", "s", "n"]


def dumped(value, **how):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, allow_nan=False, **how)


def test_compact_rows(spark):
    got = sorted(r.json for r in canonical_json(spark.createDataFrame(ROWS, SCHEMA).repartition(3)).collect())
    assert got == sorted(dumped(dict(zip(NAMES, r)), separators=(",", ":")) for r in ROWS)


def drop(value):
    if isinstance(value, dict):
        return {k: drop(v) for k, v in value.items() if v is not None}
    return [drop(v) for v in value] if isinstance(value, list) else value


@pytest.mark.parametrize("how", ["none", "top", "all"])
def test_whole_files_and_dropped_nulls(spark, how):
    got = {r.n: r.json for r in canonical_json(spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "n AS key"), 2, how, keep=["key"]).withColumnRenamed("key", "n").collect()}
    for r in ROWS:
        value = dict(zip(NAMES, r))
        value = drop(value) if how == "all" else {k: v for k, v in value.items() if v is not None} if how == "top" else value
        if r[4] != 0:  # two rows share that number
            assert got[r[4]] == dumped(value, indent=2) + "\n"


def test_refusals(spark):
    for bad in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="JSON compliant"):
            canonical_json(spark.createDataFrame([([bad],)], "x array<double>")).collect()
    for kind in ("x binary", "x float", "x map<int,string>"):
        with pytest.raises(ValueError, match="canonical JSON|keys of JSON"):
            canonical_json(spark.createDataFrame([], kind))


def test_dates_and_decimals(spark):
    row = (datetime.date(2024, 2, 29), Decimal("1.50"), datetime.datetime(2024, 1, 2, 3, 4, 5))
    got = canonical_json(spark.createDataFrame([row], "d date, x decimal(10,2), t timestamp_ntz")).first().json
    assert got == '{"d":"2024-02-29","t":"2024-01-02T03:04:05","x":"1.50"}'


def test_digests(spark):
    rows = [(1, "a", None), (2, None, {"k": None, "b": 1.5})]
    got = {r.i: r.digest for r in row_digest(spark.createDataFrame(rows, "i int, s string, o struct<k:int,b:double>"), ["i"]).collect()}
    want = [{"i": 1, "s": "a"}, {"i": 2, "o": {"k": None, "b": 1.5}}]
    assert got == {v["i"]: hashlib.sha256((dumped(v, indent=2) + "\n").encode()).hexdigest() for v in want}
    later = spark.createDataFrame([(1, "a", None, None)], "i int, s string, o struct<k:int,b:double>, new string")
    assert row_digest(later, ["i"]).first().digest == got[1], "a column without a value changes no digest"
    assert row_digest(later.limit(0), ["i"]).count() == 0
