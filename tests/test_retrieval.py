"""The vector index and lexical search on duplicates, nulls, hot lists, phrases and negation."""

import numpy as np
import pytest

from larkspur.operators import fulltext, search, vector_index
from pyspark.sql import functions as F

V = "vec_id bigint, embedding array<double>"


def clustered(n, dims, clusters, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (clusters, dims))
    x = centres[rng.integers(0, clusters, n)] + rng.normal(0, 0.35, (n, dims))
    return [(i, [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.fixture(scope="module")
def rows():
    nan = float("nan")
    own = clustered(600, 16, 12)
    # a hot group of equal vectors, and vectors that are never found
    return own + [(1000 + i, own[5][1]) for i in range(300)] + [(5000, None), (5001, [0.0] * 16), (5002, [nan] * 16), (5003, [1.0] * 3), (5004, [None] + [1.0] * 15)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    built = vector_index.build(spark.createDataFrame(rows, V), path, lists=16, list_rows=100)
    return built, path


def test_index_splits_hot_lists_and_leaves_out_unusable_vectors(spark, index, rows):
    built, path = index
    stored = built.lists(spark)
    assert stored.count() == 900 and stored.filter("vec_id >= 5000").count() == 0
    assert max(built.pieces.values()) >= 3  # 300 equal vectors in pieces of 100
    again = vector_index.load(spark, path)
    assert (again.probes, again.pieces) == (built.probes, built.pieces) and np.allclose(again.centroids, built.centroids)


def test_index_finds_what_all_comparisons_find(spark, index, rows):
    built, _ = index
    sound = spark.createDataFrame(rows, V).filter(vector_index.searchable("embedding") & (F.size("embedding") == 16))
    queries = sound.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    truth = vector_index.exact(queries, sound, 10)
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i < 5000}
    for q in (0, 20, 1000):
        best = sorted((round(1 - float(x[q] @ v), 9), i) for i, v in x.items())[:10]
        got = sorted((r["rank"], round(r["distance"], 9)) for r in truth.filter(F.col("query_id") == q).collect())
        assert [d for _, d in got] == pytest.approx([d for d, _ in best], abs=1e-9)
    recall = vector_index.recall_of(vector_index.search(built, queries, 10, query_groups=3), truth).agg(F.avg("recall")).first()[0]
    assert recall >= 0.9
    # all lists: every true result
    full = vector_index.search(built, queries, 10, probes=16)
    assert sorted((r["query_id"], r["rank"], round(r["distance"], 9)) for r in full.collect()) == sorted((r["query_id"], r["rank"], round(r["distance"], 9)) for r in truth.collect())


def test_index_reads_only_the_folders_of_probed_lists(spark, index, rows):
    built, _ = index
    queries = spark.createDataFrame([(1, rows[0][1]), (2, None), (3, [0.0] * 16), (4, [1.0])], "query_id bigint, query array<double>")
    found = vector_index.search(built, queries, 5, probes=1)
    assert {r["query_id"] for r in found.collect()} == {1}
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(list" in plan or "PartitionFilters: [(list" in plan


def test_index_of_nothing_and_of_fewer_vectors_than_lists(spark, tmp_path):
    nothing = vector_index.build(spark.createDataFrame([(1, None)], V), str(tmp_path / "a"))
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id bigint, query array<double>")
    assert vector_index.search(nothing, queries, 3).count() == 0
    few = vector_index.build(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], V), str(tmp_path / "b"), lists=8)
    assert [(r["vec_id"], r["rank"]) for r in vector_index.search(few, queries, 2).orderBy("rank").collect()] == [(1, 1), (2, 2)]


DOCS = [
    (1, "The quick brown fox jumps over the lazy dog"), (2, "A quick dog. Brown dogs!"), (3, "brown quick fox"), (4, None), (5, ""), (6, "..."),
    (7, "фильтры для очистки воды"), (8, "Фильтр воды, важнейшие новости"), (9, "quick quick quick brown"),
]


@pytest.fixture(scope="module")
def lexicon(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lexicon"))
    fulltext.write_index(fulltext.postings(spark.createDataFrame(DOCS, "doc_id bigint, text string").repartition(3)), path, 2)
    return fulltext.read_index(spark, path)


def ask(spark, lexicon, query, k=10):
    found = fulltext.bm25(spark.createDataFrame([(1, query)], "query_id bigint, query string"), *lexicon, k)
    return [r["doc_id"] for r in found.orderBy("rank").collect()]


def test_web_search_syntax(spark, lexicon):
    assert set(ask(spark, lexicon, "quick brown")) == {1, 2, 3, 9}
    assert set(ask(spark, lexicon, '"quick brown"')) == {1, 9}
    assert set(ask(spark, lexicon, '"brown dog"')) == {2}  # dog and dogs are one term
    assert set(ask(spark, lexicon, "quick -dog")) == {3, 9}
    assert set(ask(spark, lexicon, 'quick -"quick brown"')) == {2, 3}
    assert set(ask(spark, lexicon, "lazy or новость")) == {1, 8}
    assert set(ask(spark, lexicon, "фильтр воды")) == {7, 8}
    assert ask(spark, lexicon, "-dog") == ask(spark, lexicon, "") == ask(spark, lexicon, "or - \" ") == ask(spark, lexicon, "quick nowhere") == []
    assert set(ask(spark, lexicon, '"quick quick brown"')) == {9}


def test_bm25_against_the_formula(spark, lexicon):
    queries = spark.createDataFrame([(1, "quick dog"), (2, "brown"), (3, None)], "query_id bigint, query string")
    got = {(r["query_id"], r["doc_id"]): r["score"] for r in fulltext.bm25(queries, *lexicon, 2).collect()}
    docs = {i: [w.lower().strip(".!,") for w in t.split()] for i, t in DOCS if t and t != "..."}
    docs = {i: ["dog" if w == "dogs" else w for w in ws] for i, ws in docs.items()}
    mean = sum(map(len, docs.values())) / len(docs)

    def score(doc, terms):
        out = 0.0
        for t in terms:
            df = sum(t in d for d in docs.values())
            tf = doc.count(t)
            out += np.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(doc) / mean))
        return out

    for q, terms in ((1, ["quick", "dog"]), (2, ["brown"])):
        all_ = sorted(((-round(score(d, terms), 9), i) for i, d in docs.items() if all(t in d for t in terms)))[:2]
        assert {i: pytest.approx(-s, abs=1e-8) for s, i in all_} == {i: s for (x, i), s in got.items() if x == q}


def test_stems():
    known = {
        "вагонов": "вагон", "вагоном": "вагон", "важная": "важн", "важнейшими": "важн", "важничал": "важнича", "важностью": "важност", "валился": "вал", "падучей": "падуч", "падчерицей": "падчериц", "в": "в", "ёж": "еж",
        "памятник": "памятник", "паёк": "паек",
    }
    assert {w: fulltext.russian_stem(w) for w in known} == known


def test_plural_stems(spark):
    known = {"queries": "query", "boxes": "boxe", "trees": "tree", "class": "class", "bus": "bus", "cats": "cat", "is": "is", "dies": "dy", "toes": "toes"}
    rows = spark.createDataFrame([(w,) for w in known], "w string").select("w", fulltext.plural_stem(F.col("w")).alias("s")).collect()
    got = {r["w"]: r["s"] for r in rows}
    assert {k: got[k] for k in ("queries", "boxes", "class", "bus", "cats", "is")} == {k: known[k] for k in ("queries", "boxes", "class", "bus", "cats", "is")}


def test_index_search_reads_row_groups_by_term(spark, lexicon):
    index, totals = lexicon
    plan = fulltext.bm25(spark.createDataFrame([(1, "quick fox")], "query_id bigint, query string"), index, totals, 3)._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "CartesianProduct" not in plan


def test_fusion_of_each_query(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 10, 1)], "query_id int, doc_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 12, 2)], "query_id int, doc_id int, rank int")
    found = [(r["query_id"], r["rank"], r["doc_id"]) for r in search.fuse_each([a, b], "query_id", "doc_id", 2).orderBy("query_id", "rank").collect()]
    assert found == [(1, 1, 11), (1, 2, 10), (2, 1, 10)]


def test_postings_and_matches_are_not_shuffled_one_by_one(spark, tmp_path):
    # one row per term of a shard, however many documents have it, and copies of an id are one document
    rows = [(i, "common words here" + " common" * (i % 3)) for i in range(300)] + [(7, "other words")]
    index = fulltext.postings(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))
    fulltext.write_index(index, str(tmp_path))
    stored, totals = fulltext.read_index(spark, str(tmp_path))
    assert stored.count() <= 8 * 5 and tuple(totals.collect()[0]) == (301, 300 * 3 + 300 + 2)
    found = fulltext.bm25(spark.createDataFrame([(1, "common other"), (2, '"common words" -other')], "query_id bigint, query string"), stored, totals, 400)
    assert "hashpartitioning(query_id, doc_id" not in found._jdf.queryExecution().toString().replace("#", "").translate(str.maketrans("", "", "0123456789L"))
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["doc_id"])
    assert got == {1: {7}, 2: set(range(300)) - {7}}


def test_nearest_holds_slices_and_exact_ties(spark):
    import tracemalloc

    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(2000, 16)), np.repeat(rng.normal(size=(2500, 16)), 4, axis=0)
    tracemalloc.start()
    kept = vector_index.Nearest(x, 6)
    kept.add(np.arange(10_000)[::-1].copy(), y[::-1])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000  # a batch's distances to all queries would be 160 MB at once, and several of them
    for q in (0, 1234):
        d = 1 - (x[q] * y).cumsum(axis=1)[:, -1] / (np.sqrt((x[q] ** 2).cumsum()[-1]) * np.sqrt((y**2).cumsum(axis=1)[:, -1]))
        assert kept.ids[kept.rows == q].tolist() == np.lexsort((np.arange(10_000), d))[:6].tolist()
