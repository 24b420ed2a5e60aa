"""Flows up to their stop nodes, registered functions, variables, fuzzy matches and the layout by tenant, against plain versions."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from larkspur.operators import chunks, flows, fuzzy, registered, tenants

LINKS = "source string, target string"


def tables(spark, nodes, links):
    return spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(links, LINKS)


def test_run_order_against_a_plain_walk(spark):
    random.seed(3)
    names = [f"n{i}" for i in range(30)]
    links = sorted({(names[a], names[b]) for a, b in (sorted(random.sample(range(30), 2)) for _ in range(45))})
    nodes, edges = tables(spark, names, links + links[:5])
    stops = spark.createDataFrame([("n29",), ("n20",), ("n29",)], "id string")
    run, problems = flows.run_order(nodes, edges, stops)
    assert problems.count() == 0
    level = {}
    for n in names:
        level[n] = max((level[a] + 1 for a, b in links if b == n), default=0)
    want = set()
    for stop in ("n29", "n20"):
        seen, frontier, d = {stop: 0}, {stop}, 0
        while frontier:
            d += 1
            frontier = {a for a, b in links if b in frontier} - set(seen)
            seen |= dict.fromkeys(frontier, d)
        want |= {(stop, n, level[n], d) for n, d in seen.items()}
    assert {(r["stop"], r["id"], r["level"], r["distance"]) for r in run.collect()} == want


def test_cycles_are_named_and_what_is_behind_them(spark):
    nodes, links = tables(spark, "abcdefgx", [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("e", "d"), ("d", "f"), ("g", "g"), ("g", "f"), ("f", None), (None, "f"), ("y", "f")])
    stops = spark.createDataFrame([("f",), ("x",), ("z",), (None,)], "id string")
    run, problems = flows.run_order(nodes, links, stops)
    assert {(r["stop"], r["id"], r["level"]) for r in run.collect()} == {("f", "a", 0), ("f", "e", 0), ("x", "x", 0)}
    assert {(r["stop"], r["id"], r["problem"]) for r in problems.collect()} == {("f", "b", "cycle"), ("f", "c", "cycle"), ("f", "g", "cycle"), ("f", "d", "behind a cycle"), ("f", "f", "behind a cycle"), ("f", "y", "no node"), ("z", "z", "no node")}
    assert flows.run_order(nodes.limit(0), links.limit(0), stops.limit(0))[0].count() == 0


def test_splitters_in_sql_give_the_rows_of_the_frames(spark):
    texts = ["one two. Three four! Five?\n\nSix " * 40, "", None, "x" * 2500, "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert registered.register(spark, ["split_recursive", "split_sentences", "approx_tokens"], "my_") == ["my_split_recursive", "my_split_sentences", "my_approx_tokens"]
    got = spark.sql("SELECT doc_id, c.* FROM {docs} d, LATERAL my_split_recursive(d.text, 300, 50) c", docs=docs)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chunks.recursive_chunks(docs, size=300, overlap=50).collect()))
    sentences = spark.sql("SELECT doc_id, c.chunk_no, c.start, c.chunk FROM {docs} d, LATERAL my_split_sentences(d.text, 100, 10) c", docs=docs)
    assert sorted(map(tuple, sentences.collect())) == sorted(map(tuple, chunks.sentence_chunks(docs, size=100, overlap=10).collect()))
    counted = spark.sql("SELECT doc_id, my_approx_tokens(text) AS n FROM {docs}", docs=docs)
    assert [r["n"] for r in counted.orderBy("doc_id").collect()] == [None if t is None else -(-len(t) // 3) for t in texts]
    # the optimizer puts the function's body in the place of its call
    assert "my_approx_tokens" not in counted._jdf.queryExecution().executedPlan().toString() and "length" in counted._jdf.queryExecution().executedPlan().toString()
    for bad in ("my_split_recursive(d.text, 0)", "my_split_recursive(d.text, 10, 10)", "my_split_recursive(d.doc_id)", "my_split_recursive(d.text, d.doc_id)"):
        with pytest.raises(Exception):
            spark.sql(f"SELECT * FROM {{docs}} d, LATERAL {bad} c", docs=docs).collect()
    with pytest.raises(LookupError):
        registered.register(spark, ["nothing"])


def test_tools_name_operators_and_never_run_their_source(spark):
    tools = spark.createDataFrame([("cut_text", "split_recursive"), ("evil", "import os; os.remove('x')"), ("bad name", "mask_value"), ("m; DROP", "mask_value"), ("tail", "mask_value"), (None, "mask_value")], "name string, func string")
    assert registered.register_tools(spark, tools) == ["cut_text", "tail"]
    assert spark.sql("SELECT tail('abcdefgh') AS t").first()["t"] == "efgh"
    assert spark.sql("SELECT count(*) AS n FROM cut_text('a b c')").first()["n"] == 1
    problems = {r["name"]: r["p"] for r in tools.select("name", registered.tool_problem(F.col("name"), F.col("func")).alias("p")).collect()}
    assert problems == {"cut_text": None, "evil": "no such operator", "bad name": "name", "m; DROP": "name", "tail": None, None: "name"}


def test_variables_change_what_a_statement_gives(spark):
    spark.createDataFrame([(1, "a'b"), (2, "c\\d"), (3, "a'b")], "i int, s string").createOrReplaceTempView("rows_of_test")
    rows = spark.createDataFrame([("wanted", "static", "a'b"), ("later", "runtime", "ignored"), ("gone", "runtime", None)], "name string, type string, value string")
    assert registered.set_variables(spark, rows, {"later": "c\\d"}) == ["gone", "later", "wanted"]
    find = lambda *names: [r["i"] for r in registered.with_variables(spark, "SELECT i FROM rows_of_test WHERE s = ? AND i <> 9 AND s <> 'it''s' ORDER BY i", *names).collect()]
    assert find("wanted") == [1, 3] and find("later") == [2] and find("gone") == []
    registered.set_variable(spark, "wanted", "c\\d")
    assert find("wanted") == [2]
    registered.set_variable(spark, "least", "2", "BIGINT")
    assert [r["i"] for r in spark.sql("SELECT i FROM rows_of_test WHERE i >= least ORDER BY i").collect()] == [2, 3]
    with pytest.raises(ValueError):
        registered.set_variable(spark, "a; DROP TABLE x", "1")
    with pytest.raises(ValueError):
        registered.set_variable(spark, "a", "1", "ARRAY<INT>")


def grams(x):
    x = f"  {x.lower()} "
    return {x[i : i + 3] for i in range(len(x) - 2)}


def test_similar_names_against_all_pairs(spark):
    random.seed(5)
    names = ["".join(random.choice("abc") for _ in range(random.randrange(0, 9))) for _ in range(150)] + ["ABC-100", "abc-100", "ABC-1000", "Ä", "ä", ""]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "n string").repartition(5)
    for threshold in (0.4, 0.6, 1.0):
        want = {(a, b) for a, b in itertools.combinations(sorted(set(names)), 2) if len(grams(a) & grams(b)) >= threshold * len(grams(a) | grams(b)) - 1e-9}
        assert {(r["a"], r["b"]) for r in fuzzy.similar(df, "n", threshold).collect()} == want
    got = {r["class"]: (r["copies"], r["n_links"]) for r in fuzzy.link_counts(df, "n", 0.6).collect()}
    for a in set(names):
        links = sum(len(grams(a) & grams(b)) >= 0.6 * len(grams(a) | grams(b)) - 1e-9 for b in names) - 1
        assert got[a] == (names.count(a), links)
    assert fuzzy.similar(df.limit(0), "n", 0.5).count() == 0


def test_a_search_reads_one_tenant_and_hot_ones_are_cut(spark, tmp_path):
    rows = [(i, [float(i % 7), 1.0], "hot" if i < 500 else f"t{i % 5}") for i in range(1000)] + [(2000, [1.0, 0.0], None)]
    tenants.write(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, tenant string").repartition(4), str(tmp_path / "t"), rows=100)
    whole = spark.read.parquet(str(tmp_path / "t"))
    assert whole.count() == 1001
    hot = tenants.read(spark, str(tmp_path / "t"), "tenant", "hot")
    assert hot.count() == 500 and hot.select(F.input_file_name()).distinct().count() >= 3
    assert tenants.read(spark, str(tmp_path / "t"), "tenant", "t1").select(F.input_file_name()).distinct().count() == 1
    found = tenants.top_k(spark, str(tmp_path / "t"), "tenant", "t1", [1.0, 0.0], 2)
    assert all(r["vec_id"] % 5 == 1 for r in found.collect())
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(tenant" in plan and "(tenant" in plan


def test_levels_are_worked_out_once_without_cycles(spark, monkeypatch):
    asked, real = [], flows.levels
    monkeypatch.setattr(flows, "levels", lambda *args: asked.append(1) or real(*args))
    links = spark.createDataFrame([("a", "b"), ("b", "c")], "source string, target string")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    run, problems = flows.run_order(nodes, links, nodes.filter("id = 'c'"))
    assert {(r["id"], r["level"], r["distance"]) for r in run.collect()} == {("a", 0, 2), ("b", 1, 1), ("c", 2, 0)} and problems.isEmpty()
    assert len(asked) == 1
