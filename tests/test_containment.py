"""JSON containment both ways, and the table function in SQL."""

import json

import pytest
from pyspark.sql import functions as F

from brevia.functions import containment
from brevia.sources import sql_search

CASES = [
    ('{"a": 1, "b": {"c": [1, 2, {"d": "x"}]}}', {"b": {"c": [{"d": "x"}]}}, True), ('{"a": 1, "b": {"c": [1, 2, {"d": "x"}]}}', {"b": {"c": [2, 1, 1]}}, True), ('{"a": 1}', {"a": 1.0}, True), ('{"a": 1.0}', {"a": 1}, True),
    ('{"a": true}', {"a": 1}, False), ('{"a": 1}', {"a": True}, False), ('{"a": "1"}', {"a": 1}, False), ('{"a": null}', {"a": None}, True), ("{}", {"a": None}, False), ('{"a": [[1, 2], [3]]}', {"a": [[2]]}, True),
    ('{"a": [[1, 2], [3]]}', {"a": [[2, 3]]}, False), ('{"a": {"b": 1}}', {"a": {}}, True), ('{"a": 1}', {"a": {}}, False), ("[1, \"x\"]", "x", True), ("[[\"x\"]]", "x", False), ('"x"', "x", True), ("5", 5, True),
    ("[]", {}, False), ("{}", {}, True), ("{}", [], False), ("[1, [2]]", [[]], True), ('{"it\'s.a[0] key": 2}', {"it's.a[0] key": 2}, True), ('{"a": 12345678901234567890}', {"a": 12345678901234567890}, True),
    ('{"a": 0.5}', {"a": 0.5}, True), ("{broken", {}, False), (None, {}, False), ('{"a": "\\u00e4"}', {"a": "ä"}, True), ("null", None, True), ("[null]", None, True),
]


@pytest.mark.parametrize("text, wanted, want", CASES)
def test_both_forms(spark, text, wanted, want):
    df = spark.createDataFrame([(text, json.dumps(wanted))], "j string, w string")
    got = df.select(containment.holds(containment.parsed(F.col("j")), wanted).alias("native"), containment.json_holds("j", "w").alias("by_value")).first()
    assert (got.native, got.by_value) == (want, want)


def test_broken_filters_hold_nothing(spark):
    df = spark.createDataFrame([("{}", "{"), ("{}", None)], "j string, w string")
    assert [r.x for r in df.select(containment.json_holds("j", "w").alias("x")).collect()] == [False, False]
    with pytest.raises(ValueError, match="quotes"):
        containment.holds(F.col("v"), {"a'\"": 1})


def test_search_in_sql(spark):
    rows = [(1, 7, [1.0, 0.0], '{"k": [1]}'), (2, 7, [0.6, 0.8], '{"k": [2]}'), (3, 8, [1.0, 0.0], "{"), (4, 8, None, "{}"), (5, 8, [0.0, 0.0], "{}"), (6, 8, [1.0], "{}"), (7, 8, [1.0, 0.0], None)]
    sql_search.register(spark.createDataFrame(rows, "chunk_id long, document_id long, embedding array<float>, metadata string"), "found")
    ids = lambda args: [r.chunk_id for r in spark.sql(f"SELECT * FROM found(array(1D, 0D), {args}) ORDER BY similarity DESC, chunk_id").collect()]
    assert ids("10, -1D, NULL, NULL") == [1, 3, 7, 2, 5]
    assert ids("10, 0.5D, NULL, NULL") == [1, 3, 7, 2]
    assert ids("2, -1D, NULL, NULL") == [1, 3]
    assert ids("10, -1D, '{}', NULL") == [1, 2, 5]
    assert ids("10, -1D, '{\"k\": [2]}', NULL") == [2]
    assert ids("10, -1D, NULL, 8") == [3, 7, 5]
    # for each row of a table
    each = spark.sql("SELECT least, count(*) AS n FROM VALUES (-1D), (0.9D) AS t(least), LATERAL found(array(1D, 0D), 10, t.least, NULL, NULL) GROUP BY least")
    assert {r.least: r.n for r in each.collect()} == {-1.0: 5, 0.9: 3}
