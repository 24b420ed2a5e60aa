"""Containment of JSON values, shredded filters, and documents out of JSON."""

import json

import pytest
from pyspark.sql import functions as F

from larkspur.functions import variants
from larkspur.operators import metadata
from larkspur.sources import json_loader

VALUES = [
    '{"k":7,"s":"7","a.b":1,"n":null,"t":["x","y",{"z":1}],"o":{"p":{"q":true}},"f":1.5,"it\'s":"q","":0}', '[1,"a",null,[2]]', '"a"', "null", None, "{bad", "{}", '{"k":"7"}', '{"k":7.0}', '{"k":12345678901234567890}',
    '{"t":[]}', '{"t":[["x"]]}', '{"o":{"p":null}}',
]


def plain(value, wanted, top=True):
    """Containment as the rules say it, over parsed values."""
    if isinstance(wanted, dict):
        return isinstance(value, dict) and all(k in value and plain(value[k], w, False) for k, w in wanted.items())
    if isinstance(wanted, list):
        return isinstance(value, list) and all(any(plain(x, w, False) for x in value) for w in wanted)
    if isinstance(value, list):
        return top and any(plain(x, wanted, False) for x in value)
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    return value == wanted if number(value) and number(wanted) else type(value) is type(wanted) and value == wanted


WANTED = [
    {"k": 7}, {"k": "7"}, {"a.b": 1}, {"n": None}, {"t": ["y"]}, {"t": ["y", "x"]}, {"t": [{"z": 1}]}, {"t": "x"}, {"o": {"p": {}}}, {"o": {"p": {"q": True}}}, {"o": {"p": {"q": 1}}}, {"f": 1.5}, {"it's": "q"}, {"": 0}, {},
    [], ["a"], "a", [None], None, 1, [[2]], {"t": []}, {"t": [["x"]]}, {"k": 12345678901234567890}, {"k": 12345678901234567891}, {"k": 7, "s": "7"}, {"missing": None}, {"o": {"p": None}},
]


def test_containment_against_parsed_values(spark):
    rows = spark.createDataFrame(list(enumerate(VALUES)), "i int, j string").withColumn("v", F.try_parse_json("j"))
    got = rows.select("i", *(variants.contains(F.col("v"), w).alias(f"w{n}") for n, w in enumerate(WANTED))).collect()
    for r in got:
        try:
            value, known = json.loads(VALUES[r["i"]]), True
        except (TypeError, ValueError):
            value, known = None, False
        for n, w in enumerate(WANTED):
            assert r[f"w{n}"] == (known and plain(value, w)), (VALUES[r["i"]], w)


def test_only_json_values_are_wanted():
    with pytest.raises(TypeError):
        variants.contains(F.lit(1), {"k": object()})


def test_absent_key_and_alternative(spark):
    rows = spark.createDataFrame([(1, '{"u":1}'), (2, '{"u":1,"chat":null}'), (3, '{"u":2,"chat":"x"}'), (4, None)], "i int, m string").withColumn("v", F.try_parse_json("m"))
    find = lambda **o: {r["i"] for r in rows.filter(metadata.holds(F.col("v"), {"u": 1}, **o)).collect()}
    assert find() == {1, 2} and find(absent="chat") == {1} and find(absent="chat", also={"chat": "x"}) == {1, 3}


def test_shredded_keys_reach_the_scan(spark, tmp_path):
    rows = [(i, json.dumps({"user": i if i % 2 else str(i), "big": i > 5, "x.y": i / 2})) for i in range(20)]
    keys = {"user": "bigint", "big": "boolean", "x.y": "double"}
    metadata.shredded(spark.createDataFrame(rows, "i int, m string"), "m", keys).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    find = lambda w, **o: metadata.filtered(table, "m", w, keys, **o)
    ids = lambda df: {r["i"] for r in df.collect()}
    assert ids(find({"user": 7})) == {7} and ids(find({"user": "8"})) == {8} and ids(find({"user": 8})) == set() and ids(find({"big": False})) == set(range(6)) and ids(find({"x.y": 3})) == {6}
    assert ids(find({"user": 7}, also={"user": "8"})) == {7, 8}
    plan = find({"user": 7, "big": True})._jdf.queryExecution().toString()
    assert "EqualTo(meta_user,7)" in plan and "EqualTo(meta_big,true)" in plan
    assert "meta_user" not in find({"user": "8"})._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1].split("]")[0]


NESTED = {"name": "a", "n": 1, "empty": "", "list": ["x", {"name": "b", "deep": [["y"], {}]}], "a/b": {"c~d": "z"}, "none": None}


def test_every_string_is_a_document(spark):
    raw = spark.createDataFrame([(1, json.dumps(NESTED)), (2, '"s"'), (3, "[]"), (4, "{bad"), (5, None)], "id int, j string")
    docs = json_loader.json_strings(raw, "j", given={"name": "/name", "x": "/list/0", "c": "/a~1b/c~0d", "no": "name", "gone": "/gone"}, omit=["x"])
    got = sorted((r["id"], r["pointer"], r["text"]) for r in docs.collect())
    assert got == [(1, "/a~1b/c~0d", "z"), (1, "/list/0", "x"), (1, "/list/1/deep/0/0", "y"), (1, "/list/1/name", "b"), (1, "/name", "a"), (2, "", "s")]
    assert [r["metadata"] for r in docs.collect() if r["id"] == 1][0] == {"name": "a", "c": "z"}
    assert json_loader.json_strings(raw.limit(0), "j").count() == 0


def test_pointers_from_any_level(spark):
    raw = spark.createDataFrame([(1, json.dumps([NESTED, NESTED["list"][1]]))], "id int, j string")
    find = lambda *p: sorted(r["pointer"] for r in json_loader.json_strings(raw, "j", p).collect())
    assert find("/name") == ["/0/list/1/name", "/0/name", "/1/name"] and find("/list/0", "/deep") == ["/0/list/0", "/0/list/1/deep/0/0", "/1/deep/0/0"]
    assert find("name") == []  # no pointer finds nothing
    assert sorted(r["pointer"] for r in json_loader.json_strings(raw, "j", depth=2).collect()) == ["/0/name", "/1/name"]


def test_one_document_per_object(spark):
    raw = spark.createDataFrame([(1, json.dumps([{"b": 1, "a": "x"}, "no", {"a": {"c": [1]}}])), (2, '{"a":"y"}'), (3, '"s"'), (4, None)], "id int, j string")
    docs = json_loader.json_objects(raw, "j", {"a": "/a", "b": "/b"})
    assert sorted((r["id"], r["number"], r["text"]) for r in docs.collect()) == [(1, 0, '{"a":"x","b":1}'), (1, 2, '{"a":{"c":[1]}}'), (2, 0, '{"a":"y"}')]
    assert [r["metadata"] for r in docs.orderBy("id", "number").collect()][0] == {"a": "x", "b": "1"}


def test_leaves_of_too_many_levels(spark):
    raw = spark.createDataFrame([("[" * 70 + '"x"' + "]" * 70,)], "j string")
    with pytest.raises(ValueError):
        json_loader.json_strings(raw, "j")


def test_filters_share_one_scan(spark):
    rows = spark.createDataFrame([(1, '{"a":1}'), (2, '{"a":"1","b":null}'), (3, "no json"), (4, None)], "id int, m string")
    found = metadata.which(rows, "m", {"one": ({"a": 1}, None, None), "null": ({"b": None}, None, None), "either": ({"a": "1"}, {"a": 1}, "b")})
    assert {(r["id"], r["filter"]) for r in found.collect()} == {(1, "one"), (1, "either"), (2, "null")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parse_json") + found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") <= 1
