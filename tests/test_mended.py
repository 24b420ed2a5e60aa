"""Cases that went wrong once: repeated and emptied items, cut descriptions, images that were not understood, odd counters and caches."""

import json

from pyspark.sql import functions as F

from larkspur.operators import answers, augment, budget, chunks, merge, refresh, registry
from larkspur.operators.models import ScriptedModel, described_stores
from larkspur.sources import objects

ITEM = "external_id string, pos int, content string, visual_description string"


def stored_of(spark, rows):
    parts = chunks.fixed_windows(spark.createDataFrame(rows, "source_id string, content string, doc_id string"), "source_id", "content").join(spark.createDataFrame([(a, d) for a, _, d in rows], "source_id string, doc_id string"), "source_id")
    return parts.select("source_id", "doc_id", "chunk_no", "chunk").withColumn("hash", merge.content_hash("chunk", "doc_id"))


def test_the_last_of_two_items_of_one_id_wins(spark):
    items = spark.createDataFrame([("a", 1, "x" * 1500, None), ("a", 2, "y" * 1500, None), ("b", 1, "z", None)], ITEM)
    done = refresh.merge_items(items, spark.createDataFrame([], "external_id string, doc_id string"), stored_of(spark, []))
    found = {(r["source_id"], r["chunk_no"]): r["chunk"][0] for r in done.chunks.collect()}
    assert found == {("a", 1): "y", ("a", 2): "y", ("b", 1): "z"}
    assert sorted((r["external_id"], r["num_added"], r["outcome"]) for r in done.outcomes.collect()) == [("a", 2, "upserted"), ("b", 1, "upserted")]


def test_an_item_that_became_empty_loses_its_chunks(spark):
    stored = stored_of(spark, [("a", "x" * 1500, "d1"), ("b", "kept", "d2")])
    mapping = spark.createDataFrame([("a", "d1"), ("b", "d2")], "external_id string, doc_id string")
    done = refresh.merge_items(spark.createDataFrame([("a", 1, "", None), ("b", 1, "kept", None)], ITEM), mapping, stored)
    assert {r["source_id"] for r in done.chunks.collect()} == {"b"}
    assert {r["external_id"]: (r["num_added"], r["num_skipped"], r["num_deleted"], r["outcome"]) for r in done.outcomes.collect()} == {"a": (0, 0, 2, "upserted"), "b": (0, 1, 0, "skipped")}


def test_what_could_not_be_deleted_stays_and_is_not_counted(spark):
    stored = stored_of(spark, [("a", "x", "d1"), ("b", "y", "d2"), ("c", "z", "d3")])
    mapping = spark.createDataFrame([("a", "d1"), ("b", "d2"), ("c", "d3")], "external_id string, doc_id string")
    done = refresh.merge_items(spark.createDataFrame([("c", 1, "z", None)], ITEM), mapping, stored, undeleted=spark.createDataFrame([("d2",)], "doc_id string"))
    assert done.counters.first()["removed"] == 1
    assert {r["source_id"] for r in done.chunks.collect()} == {"b", "c"}
    assert {r["external_id"] for r in done.mapping.collect()} == {"c"}  # the mapping loses both


def test_descriptions_cut_between_chunks_come_back_whole(spark):
    described = "".join(chr(97 + i % 26) for i in range(400))
    rows = [(str(n), "w" * n + f"\n\n{refresh.LABEL}: {described}", "d") for n in (0, 600, 700, 780, 795, 1000, 1590)]
    stored = stored_of(spark, rows).select("source_id", "chunk_no", "chunk")
    hashes = spark.createDataFrame([(n, "h") for n, _, _ in rows], "external_id string, image_hash string")
    got = {r["external_id"]: r["visual_description"] for r in refresh.recovered_descriptions(stored, hashes).collect()}
    assert got == {n: described for n, _, _ in rows}
    # chunks of another splitter, with less overlap or none
    other = spark.createDataFrame([("p", 1, "one two"), ("p", 2, "two three"), ("p", 3, " four")], "source_id string, chunk_no int, chunk string")
    assert refresh.recovered_texts(other).first()["text"] == "one two three four"


def test_images_are_understood_once_and_paid_for_only_then(spark):
    images = "array<struct<mime:string,base64:string>>"
    sound = json.dumps({"is_relevant": True, "description_ru": "filter"})
    rows = [(1, "h1", [("image/png", "AA")]), (2, "h1", [("image/png", "AA")]), (3, "h2", [("image/jpeg", "BB"), ("image/webp", "CC")]), (4, "h3", [("image/png", "DD")]), (5, None, [])]
    requests = spark.createDataFrame(rows, f"request_id int, image_hash string, images {images}")
    cache = spark.createDataFrame([("h3", sound), ("h3", sound)], "image_hash string, answer string")
    seen = answers.understood(requests, cache, ScriptedModel({'"image-0.png","mime":"image/png","data":"data:image/png;base64,AA"': "```json\n" + sound + "\n```"}, "no JSON"))
    assert sorted(map(tuple, seen.collect())) == [("h1", True, "filter", False), ("h2", None, None, False), ("h3", True, "filter", True)]
    asked = requests.select("request_id", F.lit("q").alias("query"), F.size("images").alias("n_images"), "image_hash", F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    vectors = spark.createDataFrame([(10, [1.0, 0.0])], "vec_id int, embedding array<double>")
    done = answers.answer(asked, vectors, seen, spark.createDataFrame([], "category string, spent string"), {"vision": 1.0, "embedding": 1.0}, 1)
    assert {(r["request_id"], r["problem"]) for r in done.rejected.collect()} == {(3, "not understood")}
    assert {(r["request_id"], round(r["usd"], 4)) for r in done.spend.collect() if r["category"] == "vision"} == {(1, 0.007), (2, 0.007)}


def test_counters_that_begin_with_infinity(spark):
    rows = spark.createDataFrame([("Infinity",), (" +Infinityx",), ("-Infinity",), ("infinity",), ("NaN",), ("5.0",), (None,)], "s string")
    assert [r[0] for r in rows.select(budget.blocked(F.col("s"), 5.0)).collect()] == [True, True, False, False, False, True, False]


def test_several_cache_rows_of_a_key_are_one(spark):
    now = F.lit("2025-01-01").cast("timestamp")
    asked = spark.createDataFrame([(1, "q")], "i int, query string")
    cache = asked.select(F.sha2("query", 256).alias("query_hash")).crossJoin(spark.createDataFrame([("old", "2025-02-01"), ("new", "2025-03-01"), ("dead", "2024-01-01")], "result string, e string")).select("query_hash", "result", F.col("e").cast("timestamp").alias("expires_at"))
    assert [r["result"] for r in answers.remembered(asked, cache, now).collect()] == ["new"]
    items = spark.createDataFrame([("a", "h"), ("b", "h")], "k string, image_hash string")
    rows = spark.createDataFrame([("a", "h", "d", "m2"), ("a", "h", "c", "m2"), ("a", "old", "x", "m2"), ("a", "h", "x", "m1"), ("b", "h", "x", "m1")], "k string, image_hash string, visual_description string, model_version string")
    assert sorted(map(tuple, augment.cached(items, rows, "k", "m2").select("k", "hit", "visual_description").collect())) == [("a", True, "c"), ("b", False, None)]


def test_last_rows_of_equal_turns_are_the_same_every_time(spark):
    rows = [("s", 1, "a"), ("s", 2, "b"), ("s", 2, "c"), ("s", 2, "d")]
    for parts in (1, 3):
        got = registry.last_each(spark.createDataFrame(rows, "session string, turn int, text string").repartition(parts), "session", "turn", 2).collect()
        assert {r["text"] for r in got} == {"c", "d"}


def test_a_snapshot_is_skipped_by_its_digest(spark):
    items = spark.createDataFrame([("a", 1, "x", None), ("b", 2, "y", "seen")], ITEM)
    mapping, stored = spark.createDataFrame([], "external_id string, doc_id string"), stored_of(spark, [])
    done, digest = refresh.refresh_snapshot(items, mapping, stored, None)
    assert done.counters.first()["upserted"] == 2
    assert refresh.refresh_snapshot(items.orderBy(F.desc("pos")), mapping, stored, digest) == (None, digest)
    changed, other = refresh.refresh_snapshot(items.withColumn("visual_description", F.lit("seen")), mapping, stored, digest)
    assert changed is not None and other != digest and refresh.snapshot_digest(items.limit(0)) == ""


def test_objects_are_put_with_etags(spark):
    stored = spark.createDataFrame([("a", b"1", "c4ca4238a0b923820dcc509a6f75849b", 1, "t0"), ("b", b"2", "x", 1, "t0")], "object_key string, content binary, etag string, length int, modified string")
    new = spark.createDataFrame([("a", b"1"), ("b", b"22"), ("c", b""), ("c", b"")], "object_key string, content binary")
    got = {r["object_key"]: (bytes(r["content"]), r["length"], r["modified"]) for r in objects.put_objects(stored, new, F.lit("t1")).collect()}
    assert got == {"a": (b"1", 1, "t0"), "b": (b"22", 2, "t1"), "c": (b"", 0, "t1")}


def test_stores_are_described_by_a_model(spark):
    stores = spark.createDataFrame([(1, "filters"), (2, "empty"), (3, "odd")], "id int, name string")
    rows = spark.createDataFrame([(1, n, f"chunk {n}") for n in range(1, 6)], "store_id int, chunk_no int, chunk string")
    model = ScriptedModel({'"samples":["chunk 1","chunk 2","chunk 3"]': "About filters.", '"empty","samples":[]': "Nothing yet."})
    assert {r["id"]: r["description"] for r in described_stores(stores, rows, model).collect()} == {1: "About filters.", 2: "Nothing yet.", 3: None}


def test_grouped_deals_rows_into_tasks_by_their_number(spark, monkeypatch):
    """A task's rows do not grow with the table, however few partitions the session has."""
    monkeypatch.setattr(answers, "TASK_ROWS", 10, raising=False)
    items = spark.range(100).selectExpr("cast(id as string) item_id", "'order' kind")
    related = spark.range(200).selectExpr("cast(id div 2 as string) item_id", "concat('p', id % 7) related_id", "'part' kind")
    found = items.filter("item_id < '5'").select("item_id").unionAll(spark.createDataFrame([("7",), ("7",), (None,), ("none",)], "item_id string"))
    out = answers.grouped(found, items.unionAll(items.limit(3)).unionAll(spark.createDataFrame([(None, "order")], "item_id string, kind string")), related)
    assert out.rdd.getNumPartitions() >= 30
    ids = {r[0] for r in found.collect()} - {None, "none"}
    want = {("order", i): [i] for i in ids}
    for i in range(200):
        if str(i // 2) in ids:
            want.setdefault(("part", f"p{i % 7}"), []).append(str(i // 2))
    assert {(r["kind"], r["id"]): r["source_ids"] for r in out.collect()} == {k: sorted(set(v)) for k, v in want.items()}
