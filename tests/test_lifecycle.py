"""Stores, loaders, flows and other registered rows from creation to removal, models and embedders, and composed searches on small tables."""

import pytest
from pyspark.sql import functions as F

from larkspur.operators import answers, graph, lifecycle, models, registry


@pytest.fixture
def catalog(spark, tmp_path):
    return lifecycle.Catalog(spark, str(tmp_path / "catalog"))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_rows_are_created_patched_listed_and_deleted(spark, catalog):
    for kind, more in (("tools", {"description": "d", "source": "return 1"}), ("assistants", {"type": "OPENAI"}), ("variables", {"type": "static", "value": "v"}), ("attachments", {"mime": "text/plain"})):
        catalog.create(kind, id="a", name="one", **more)
        catalog.create(kind, id="b", name="two")
        assert ids(catalog.table(kind)) == ["a", "b"] and ids(catalog.table(kind, name="two")) == ["b"]
        catalog.update(kind, "a", name="new")
        assert catalog.get(kind, "a").first()["name"] == "new" and catalog.get(kind, "b").first()["name"] == "two"
        assert catalog.delete(kind, "a") == 1 and ids(catalog.table(kind)) == ["b"]
        for wrong in (lambda k=kind: catalog.get(k, "a"), lambda k=kind: catalog.delete(k, "a"), lambda k=kind: catalog.update(k, "a", name="x")):
            with pytest.raises(LookupError):
                wrong()
        with pytest.raises(ValueError):
            catalog.create(kind, id="b", name="again")
    with pytest.raises(ValueError, match="not allowed"):
        catalog.table("passwords")
    assert registry.picked(catalog.table("tools"), registry.TOOL).columns == ["id", "name", "description"]
    messages = spark.createDataFrame([(str(i), "f", f"c{i % 2}", "EXTERNAL" if i % 3 else "INTERNAL") for i in range(6)], "id string, chatflow_id string, chat_id string, chat_type string")
    catalog.add("messages", messages)
    assert catalog.delete("messages", chat_id="c1", chat_type="EXTERNAL") == 2 and ids(catalog.table("messages")) == ["0", "2", "3", "4"]


def test_stores_are_set_up_cloned_and_removed(spark, catalog):
    docs = spark.createDataFrame([(1, "alpha beta gamma " * 200), (2, "delta"), (3, None)], "doc_id bigint, text string")
    done = catalog.full_setup("s", "Store", "l", docs, models.HashingEmbedder(16))
    assert [(d["step"], d["success"]) for d in done] == [("create", True), ("save", True), ("process", True), ("insert", True)]
    loader = catalog.get("loaders", "l").first()
    parts = catalog.table("chunks", store_id="s")
    assert loader["total_chunks"] == parts.count() == catalog.table("vectors", store_id="s").count() > 2 and loader["total_chars"] == sum(len(r["page_content"]) for r in parts.collect())
    # the same again stops at the first step
    again = catalog.full_setup("s", "Store", "l", docs, models.HashingEmbedder(16))
    assert len(again) == 1 and not again[0]["success"] and "taken" in again[0]["problem"]
    # a loader that runs again replaces its chunks
    assert catalog.refresh_store("s", lambda loader_id: docs.filter("doc_id = 2"), models.HashingEmbedder(16)) == 1 and catalog.table("chunks").count() == 1
    chunk = catalog.table("chunks").first()["id"]
    catalog.update("chunks", chunk, page_content="edited")
    assert catalog.get("chunks", chunk).first()["page_content"] == "edited"
    catalog.update("stores", "s", embedding_config='{"name": "e", "config": {}}', vector_store_config="{broken")
    catalog.clone_store("s", "t", "Copy")
    copy = catalog.get("stores", "t").first()
    assert (copy["name"], copy["embedding_config"], copy["vector_store_config"]) == ("Copy", '{"name": "e", "config": {}}', None) and catalog.table("loaders", store_id="t").isEmpty()
    assert catalog.delete_loader("l") == 1 and catalog.table("chunks").isEmpty()
    assert catalog.delete_store("s") == 1 and ids(catalog.table("stores")) == ["t"] and catalog.table("vectors").isEmpty()
    catalog.create("flows", id="f", name="Flow", type="AGENT", deployed=True, is_public=True, flow_data="{}")
    catalog.clone_flow("f", "g", "Copy", ["CHATFLOW"])
    flow = catalog.get("flows", "g").first()
    assert (flow["type"], flow["deployed"], flow["is_public"], flow["flow_data"]) == (None, False, False, "{}")
    assert "flow_data" not in registry.flow_detail(catalog.table("flows"), "f").columns and "flow_data" in registry.flow_detail(catalog.table("flows"), "f", with_data=True).columns


def test_probes_and_names(spark):
    steps = lifecycle.probes({"good": lambda: 1, "bad": lambda: 1 / 0, "after": lambda: 2})
    assert [s["success"] for s in steps] == [True, False, True] and "ZeroDivisionError" in steps[1]["problem"] and all(s["elapsed_ms"] >= 0 for s in steps)
    rows = spark.createDataFrame([(2, "x"), (1, "x"), (3, "y")], "id int, name string")
    assert registry.find_by_name(rows, "name", "x", "id").first()["id"] == 1
    with pytest.raises(LookupError):
        registry.find_by_name(rows, "name", "z", "id")
    marked = registry.soft_delete(rows.withColumn("is_deleted", F.lit(None).cast("boolean")), "id", [1, 3])
    assert sorted(r["id"] for r in marked.filter("is_deleted").collect()) == [1, 3]


def test_models_are_asked_once(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, ""), (4, None), (5, "c")], "id int, text string")
    got = {r["id"]: r["embedding"] for r in models.embed(df, "text", models.HashingEmbedder(8)).collect()}
    assert got[1] == got[2] and got[4] is None and sum(x * x for x in got[1]) == pytest.approx(1) and set(got[3]) == {0.0}
    answered = {r["id"]: r["answer"] for r in models.predict(df, "text", models.ScriptedModel({"a": "A", "c": None}, "other")).collect()}
    assert answered == {1: "A", 2: "A", 3: "other", 4: None, 5: None}

    def broken(questions):
        raise RuntimeError("no answer today")

    assert {r["answer"] for r in models.predict(df, "text", broken).collect()} == {None}
    assert models.question({"b": 1, "a": "ä"}) == '{"a": "ä", "b": 1}'


def test_search_spends_and_rejects(spark):
    requests = spark.createDataFrame(
        [(1, "q", 0, None, [1.0, 0.0]), (2, None, 0, None, [1.0, 0.0]), (3, None, 1, "seen", [0.0, 1.0]), (4, "x", 1, "new", [0.0, 1.0]), (5, "x", 2, "cat", [0.0, 1.0]), (6, "y" * 501, 0, None, [1.0, 0.0]), (7, "x", 6, "seen", [1.0, 0.0])],
        "request_id int, query string, n_images int, image_hash string, vector array<double>",
    )
    chunks = spark.createDataFrame([(10, [1.0, 0.0], "east"), (11, [0.0, 1.0], "north"), (12, [0.6, 0.8], "between")], "vec_id int, embedding array<double>, name string")
    vision = spark.createDataFrame([("seen", True, "d", True), ("new", True, "a filter", False), ("cat", False, None, False)], "image_hash string, is_relevant boolean, description string, cached boolean")
    spent = spark.createDataFrame([("vision", "NaN"), ("embedding", "0.5")], "category string, spent string")
    got = answers.answer(requests, chunks, vision, spent, {"vision": 1.0, "embedding": 1.0}, 2, ("name",))
    assert {(r["request_id"], r["rank"]): r["name"] for r in got.results.collect()} == {(1, 1): "east", (1, 2): "between", (3, 1): "north", (3, 2): "between", (4, 1): "north", (4, 2): "between"}
    assert {r["request_id"]: r["problem"] for r in got.rejected.collect()} == {2: "no input", 5: "not relevant", 6: "query length", 7: "too many images"}
    usd = {(r["request_id"], r["category"]): round(r["usd"], 12) for r in got.spend.collect()}
    # a cached description is free, an irrelevant image is not; "x a filter" is four tokens
    assert usd == {(4, "vision"): 0.007, (5, "vision"): 0.014, (1, "embedding"): 2e-8, (3, "embedding"): 2e-8, (4, "embedding"): round(4 / 1e6 * 0.02, 12)}
    over = answers.answer(requests, chunks, vision, spark.createDataFrame([("vision", "1.0"), ("embedding", "0")], "category string, spent string"), {"vision": 1.0, "embedding": 1.0}, 2)
    assert {r["request_id"]: r["problem"] for r in over.rejected.collect()}[4] == "vision budget" and 3 not in {r["request_id"] for r in over.rejected.collect()}
    full = answers.answer(requests, chunks, vision, spark.createDataFrame([("embedding", "2x")], "category string, spent string"), {"vision": 1.0, "embedding": 1.0}, 2)
    assert full.results.isEmpty()
    uploads = spark.createDataFrame([("image/png", "eHh4"), ("image/gif", "eHh4"), ("image/png", "%"), (None, "eHh4")], "mime string, data string")
    assert [r["p"] for r in uploads.select(answers.upload_problem(F.col("mime"), F.col("data")).alias("p")).collect()] == [None, "type", "not base64", "type"]
    shown = spark.createDataFrame([(10, ["a.png", "../b"])], "vec_id int, image_urls array<string>")
    assert answers.with_urls(shown, spark.createDataFrame([("a.png", "u")], "object_key string, url string")).first()["urls"] == ["u"]


def test_tenants_have_folders_of_their_own(spark, tmp_path):
    vectors = spark.createDataFrame([(i, [float(i)], i % 3) for i in range(9)], "vec_id int, embedding array<double>, tenant int")
    lifecycle.write_by_tenant(vectors, "tenant", str(tmp_path / "v"))
    one = spark.read.parquet(str(tmp_path / "v")).filter("tenant = 1")
    assert ids(one.withColumnRenamed("vec_id", "id")) == [1, 4, 7] and "PartitionFilters: [isnotnull(tenant" in one._jdf.queryExecution().executedPlan().toString()


def test_graphs_are_cloned_and_written(spark):
    nodes = spark.createDataFrame([("a", "x", "X", "p", "Y"), ("b", "y", "Y", "q", "X")], "id string, out_name string, out_type string, in_name string, in_type string")
    links = spark.createDataFrame([("a", "b")], "source string, target string")
    twins, twin_links = graph.clone(nodes, links, "copy-")
    made, problems = graph.build(twins, twin_links)
    assert [r["id"] for r in made.collect()] == ["copy-a-copy-b"] and problems.isEmpty()
    assert sorted(r["kind"] for r in graph.to_json(twins, made).collect()) == ["edge", "node", "node"]
    assert {(r["what"], r["problem"]) for r in graph.build(nodes.unionAll(nodes), links)[1].collect()} == {("node", "repeated")}
