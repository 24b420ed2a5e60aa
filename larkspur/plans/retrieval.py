"""Queries of the vector index, lexical search, and JSON, next to the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkspur.operators import budget, flows, fulltext, fuzzy, merge, metadata, refresh, registered, search, tenants, vector_index
from larkspur.plans.catalogue import _E, _Q, first_vector, query, table
from larkspur.sources import json_loader
from larkspur.streaming.runs import shared_folder, stream_alerts, stream_limits

# vector index


def _indexed(spark, folder):
    """An index of all vectors, every hundredth id as queries, and what searching it finds."""
    vectors = table(spark, folder, "embeddings").select("vec_id", "embedding").filter(vector_index.searchable("embedding"))
    index = vector_index.build(vectors, shared_folder(spark))
    queries = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vectors, queries, vector_index.search(index, queries, 10)


@query()
def vector_index_recall(spark, folder):
    """The share of each query's ten nearest, found by comparing all vectors, that the index finds as well."""
    vectors, queries, found = _indexed(spark, folder)
    return vector_index.recall_of(found, vector_index.exact(queries, vectors, 10))


@query(f"""
WITH q AS (SELECT vec_id AS query_id, {_E} AS query FROM embeddings WHERE vec_id % 100 = 0 AND embedding IS NOT NULL),
s AS (SELECT query_id, vec_id, round(1 - list_cosine_similarity({_E}, query), 9) AS distance FROM embeddings, q WHERE embedding IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM s)
SELECT query_id, count(*) AS n, min(vec_id) FILTER (rank = 1) AS nearest, true AS recall_met, true AS sound FROM r WHERE rank <= 10 GROUP BY query_id
""")
def vector_index_search(spark, folder):
    """What the index finds for each query: how many, the nearest, whether the mean recall of all queries is at least 0.9, and whether no result is nearer than the true one of its rank."""
    vectors, queries, found = _indexed(spark, folder)
    truth = vector_index.exact(queries, vectors, 10)
    recall = vector_index.recall_of(found, truth).agg((F.avg("recall") >= 0.9).alias("recall_met"))
    both = found.join(truth.select("query_id", "rank", F.col("distance").alias("least")), ["query_id", "rank"])
    summed = both.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("rank") == 1, F.col("vec_id"))).alias("nearest"), F.bool_and(F.col("distance") >= F.col("least") - 1e-9).alias("sound"))
    return summed.crossJoin(F.broadcast(recall)).select("query_id", "n", "nearest", "recall_met", "sound")  # one row


# lexical search


def _plural(w: str) -> str:
    return (
        f"CASE WHEN length({w}) < 4 THEN {w} WHEN regexp_matches({w}, '[^ea]ies$') THEN regexp_replace({w}, 'ies$', 'y') WHEN regexp_matches({w}, '[^aeo]es$') THEN regexp_replace({w}, 's$', '') "
        f"WHEN regexp_matches({w}, '[^us]s$') AND NOT regexp_matches({w}, 'es$') THEN regexp_replace({w}, 's$', '') ELSE {w} END"
    )


_TERMS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, list_transform(w, lambda x: {_plural("x")}) AS w FROM w WHERE len(w) > 0),
t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term, unnest(range(len(w))) AS pos FROM s),
d AS (SELECT term, doc_id, dl, count(*) AS tf FROM t GROUP BY 1, 2, 3),
n AS (SELECT count(*) AS n, sum(len(w)) / count(*) AS mean FROM s),
f AS (SELECT term, ln(1 + (n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM d, n GROUP BY term, n),
q AS (SELECT s.doc_id AS query_id, s.w FROM s JOIN w USING (doc_id) WHERE doc_id % 100 = 0 AND len(w.w) >= 10 AND NOT list_contains(w.w[1:10], 'or')),
a AS (SELECT query_id, x.doc_id FROM q JOIN d x ON x.term = q.w[1] JOIN d y ON y.term = q.w[2] AND y.doc_id = x.doc_id),
b AS (
  SELECT DISTINCT query_id, x.doc_id FROM q JOIN t x ON x.term = q.w[3] JOIN t y ON y.term = q.w[4] AND y.doc_id = x.doc_id AND y.pos = x.pos + 1
  WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.doc_id = x.doc_id AND d.term = q.w[9])
),
m AS (FROM a UNION FROM b),
asked AS (SELECT DISTINCT query_id, unnest(w[1:4]) AS term FROM q),
scored AS (SELECT query_id, doc_id, sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / mean))) AS score FROM m JOIN asked USING (query_id) JOIN d USING (doc_id, term) JOIN f USING (term), n GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM scored)
"""


def _asked(spark, folder):
    """Of every hundredth document: its first two words, or its next two as a phrase without the ninth."""
    spoken = table(spark, folder, "documents").select("doc_id", fulltext.words(F.col("text")).alias("w"))
    own = spoken.filter((F.col("doc_id") % 100 == 0) & (F.size("w") >= 10) & ~F.array_contains(F.slice("w", 1, 10), "or"))
    return own.select(F.col("doc_id").alias("query_id"), F.format_string('%s %s OR "%s %s" -%s', *(F.col("w")[i] for i in (0, 1, 2, 3, 8))).alias("query"))


def _lexical(spark, folder, k):
    """The k best documents of each query, from an index that is written and read again."""
    path = shared_folder(spark)
    fulltext.write_index(fulltext.postings(table(spark, folder, "documents")), path)
    return fulltext.bm25(_asked(spark, folder), *fulltext.read_index(spark, path), k)


@query(_TERMS + "SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, round(score, 6) AS score FROM best WHERE rank <= 5")
def lexical_topk(spark, folder):
    return _lexical(spark, folder, 5).select("query_id", "rank", "doc_id", F.round("score", 6).alias("score"))


@query(_TERMS + f"""
, v AS (SELECT q.query_id, e.vec_id AS doc_id, row_number() OVER (PARTITION BY q.query_id ORDER BY 1 - list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(o.embedding AS DOUBLE[])), e.vec_id) AS rank
        FROM q JOIN embeddings o ON o.vec_id = q.query_id AND o.embedding IS NOT NULL, embeddings e WHERE e.embedding IS NOT NULL),
u AS (SELECT query_id, doc_id, rank FROM v WHERE rank <= 20 UNION ALL SELECT query_id, doc_id, rank FROM best WHERE rank <= 20),
r AS (SELECT query_id, doc_id, CAST(sum(CAST(1.0 / ({search.RECIPROCAL} + rank) AS DECIMAL(18,12))) AS DOUBLE) AS score FROM u GROUP BY 1, 2)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 10
""")  # fmt: skip
def hybrid_fulltext(spark, folder):
    """Lexical and vector results of each query, fused by reciprocal ranks."""
    vectors = table(spark, folder, "embeddings").filter(vector_index.searchable("embedding"))
    asked = _asked(spark, folder).select("query_id").join(vectors.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "query_id")
    near = vector_index.exact(asked, vectors.select("vec_id", "embedding"), 20).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    return search.fuse_each([near, _lexical(spark, folder, 20).select("query_id", "doc_id", "rank")], "query_id", "doc_id", 10)


@query(f"SELECT vec_id, label, round(1 - list_cosine_similarity({_E}, {_Q}), 9) AS distance FROM embeddings WHERE label IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 0) ORDER BY 1 - list_cosine_similarity({_E}, {_Q}), vec_id LIMIT 10")
def search_in_sources(spark, folder):
    """The nearest vectors of a list of sources (labels), which a table gives."""
    sources = table(spark, folder, "nation").filter("n_regionkey = 0").select(F.col("n_nationkey").alias("source_id"))
    found = search.top_k(search.of_sources(table(spark, folder, "embeddings"), sources, "label"), first_vector(spark, folder))
    return found.select("vec_id", "label", F.round("distance", 9).alias("distance"))


# JSON


def _customers(spark, folder):
    """Each customer as a JSON value with its orders."""
    own = table(spark, folder, "orders").select("o_custkey", F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("a/b"), F.lit("").alias("none")).alias("meta")).alias("o"))
    listed = own.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o")).alias("orders"))
    joined = table(spark, folder, "customer").join(listed, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.coalesce("orders", F.array()).alias("orders"))).alias("json"))


_NUMBERED = "o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders JOIN customer ON c_custkey = o_custkey)"


@query(f"""
WITH {_NUMBERED}
SELECT c_custkey, '/name' AS pointer, c_name AS text, c_name AS who FROM customer UNION ALL SELECT o_custkey, '/orders/' || i || '/status', o_orderstatus, c_name FROM o UNION ALL SELECT o_custkey, '/orders/' || i || '/meta/a~1b', o_orderpriority, c_name FROM o
""")
def json_all_strings(spark, folder):
    """Every string of a nested value is a document; pointers of other metadata are ignored."""
    docs = json_loader.json_strings(_customers(spark, folder), "json", given={"who": "/name", "bad": "name", "left": "/balance"}, omit=["left"])
    return docs.select("c_custkey", "pointer", "text", F.col("metadata")["who"].alias("who"))


@query(f"WITH {_NUMBERED} SELECT o_custkey AS c_custkey, '/orders/' || i || '/meta/a~1b' AS pointer, o_orderpriority AS text, 0 AS n_metadata FROM o UNION ALL SELECT c_custkey, '/name', c_name, 0 FROM customer")
def json_pointers(spark, folder):
    """Strings at or below pointers, from any level."""
    docs = json_loader.json_strings(_customers(spark, folder), "json", ["/meta", "/name", "status"], {"who": "/name"}, ["*"])
    return docs.select("c_custkey", "pointer", "text", F.size("metadata").alias("n_metadata"))


@query("SELECT o_custkey, count(*) AS n, max(o_orderstatus) AS last_status, CAST(sum(length('{\"k\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}')) AS BIGINT) AS chars FROM orders GROUP BY 1")
def json_by_object(spark, folder):
    """One document for each object of an array."""
    listed = table(spark, folder, "orders").groupBy("o_custkey").agg(F.to_json(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")))).alias("json"))
    docs = json_loader.json_objects(listed, "json", {"status": "/status", "none": "/orders/0"})
    return docs.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("metadata")["status"]).alias("last_status"), F.sum(F.length("text")).alias("chars"))


def _described(spark, folder):
    """Orders with JSON metadata: a key that is a number for some and a text for others, one with a dot, a nested object, a list, and one that is null for some and missing for others."""
    n = F.col("o_orderkey")
    text = F.concat(
        F.lit('{"user_id":'), F.when(n % 2 == 0, F.col("o_custkey").cast("string")).otherwise(F.concat(F.lit('"'), F.col("o_custkey").cast("string"), F.lit('"'))), F.lit(',"a.b":"'), F.col("o_orderstatus"),
        F.lit('","deep":{"priority":"'), F.col("o_orderpriority"), F.lit('","flag":'), (n % 3 == 0).cast("string"), F.lit('},"tags":["'), F.col("o_orderstatus"), F.lit('",'), (n % 5).cast("string"), F.lit("]"),
        F.when(n % 4 == 0, ',"chat_id":null').when(n % 4 == 1, ',"chat_id":"c"').otherwise(""), F.lit("}"),
    )
    return table(spark, folder, "orders").select("o_orderkey", text.alias("metadata"))


#: Filters, and what each means in SQL.
_FILTERS = {
    "number": ({"user_id": 5}, "o_custkey = 5 AND o_orderkey % 2 = 0"),
    "text": ({"user_id": "5"}, "o_custkey = 5 AND o_orderkey % 2 = 1"),
    "dotted": ({"a.b": "F"}, "o_orderstatus = 'F'"),
    "nested": ({"deep": {"flag": True, "priority": "1-URGENT"}}, "o_orderkey % 3 = 0 AND o_orderpriority = '1-URGENT'"),
    "any_of": ({"tags": [3, "O"]}, "o_orderkey % 5 = 3 AND o_orderstatus = 'O'"),
    "null": ({"chat_id": None}, "o_orderkey % 4 = 0"),
    "wrong_kind": ({"deep": {"flag": "true"}}, "false"),
}


@query(" UNION ALL ".join(f"SELECT '{name}' AS filter, o_orderkey FROM orders WHERE {sql}" for name, (_, sql) in _FILTERS.items()) + " UNION ALL SELECT 'absent', o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 4 NOT IN (0, 1) OR o_custkey = 5 AND o_orderkey % 2 = 0")
def metadata_containment(spark, folder):
    """Orders whose metadata contain each of some filters, and those of one filter without a key or with another."""
    path = shared_folder(spark)
    metadata.shredded(_described(spark, folder), "metadata", {"user_id": "bigint"}).write.parquet(path)
    rows = spark.read.parquet(path)
    filters = {name: (wanted, None, None) for name, (wanted, _) in _FILTERS.items()} | {"absent": ({"a.b": "O"}, {"user_id": 5}, "chat_id")}
    return metadata.which(rows, "metadata", filters).select("filter", "o_orderkey")


# limits and alerts


def _windows(keys: str, seconds: int) -> str:
    """Windows that a first request opens, found one after another for all keys at once."""
    return f"""
WITH RECURSIVE e AS (SELECT *, epoch_us(ts) AS t FROM events),
o AS (
  SELECT {keys}, min(t) AS opened FROM e GROUP BY {keys}
  UNION ALL SELECT {keys}, min(t) FROM o JOIN e USING ({keys}) WHERE t >= opened + {seconds}000000 GROUP BY {keys}
),
placed AS (SELECT e.*, opened FROM e ASOF JOIN o ON {" AND ".join(f"e.{k.strip()} = o.{k.strip()}" for k in keys.split(","))} AND e.t >= o.opened),
counted AS (SELECT *, row_number() OVER (PARTITION BY {keys}, opened ORDER BY t, event_id) AS i FROM placed),
passed AS (SELECT (max(t) - 3600000000) // 1000 * 1000 AS watermark FROM e)
"""


@query(_windows("user_id", 86400) + " SELECT event_id, i AS index, i <= 2 AS allowed, opened FROM counted")
def throttle_first_hit(spark, folder):
    """A user's window of a day opens at the first event outside of one; two events are let through in each."""
    return budget.first_hit(table(spark, folder, "events"), "user_id", "ts", "event_id", 2, 86400).select("event_id", "index", "allowed", "opened")


@query(_windows("user_id, event_type", 172800) + """
SELECT CAST(user_id AS VARCHAR) AS tracker, event_type AS route, CAST(event_id AS VARCHAR) AS id, i AS index, i <= CASE event_type WHEN 'click' THEN 1 ELSE 2 END AS allowed,
       CASE WHEN i > CASE event_type WHEN 'click' THEN 1 ELSE 2 END THEN CAST(-floor((t - opened - 172800000000) / 1000000.0) AS BIGINT) END AS retry_after FROM counted, passed WHERE t < watermark
""")  # fmt: skip
def limits_stream(spark, folder):
    """Decisions on each request by windows of each user and route, worked off as a stream; requests that the watermark has not passed wait."""
    return stream_limits(spark, folder, {"click": 1}, 2, 172800)


_CHATS = ["100", "200"]


@query("""
WITH p AS (SELECT to_timestamp(((max(epoch_us(ts)) - 3600000000) // 1000 * 1000) / 1e6)::TIMESTAMP AS w, (max(epoch_us(ts)) - 3600000000) // 1000 * 1000 AS us FROM events),
r AS (SELECT event_type AS category, strftime(ts, '%Y%m%d') AS day, ts, event_id, coalesce(sum(CAST(value AS DECIMAL(18,8))) OVER (PARTITION BY event_type, strftime(ts, '%Y%m%d') ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM events),
f AS (SELECT category, day, arg_min(CAST(before AS DOUBLE), (ts, event_id)) AS spent FROM r, p WHERE before >= 300 AND epoch_us(ts) < us GROUP BY 1, 2)
SELECT category, day, chat_id, '<b>Budget exceeded</b>' || chr(10) || chr(10) || '<b>Category:</b> ' || CASE category WHEN 'click' THEN 'Clicks' ELSE category END || chr(10)
       || '<b>Spent:</b> $' || regexp_replace(CAST(CAST(floor(spent * 10000 + 0.5) / 10000 AS DECIMAL(20,4)) AS VARCHAR), '\\.?0+$', '') || ' (cap $300, +' || CAST(floor((spent - 300) / 300 * 100 + 0.5) AS BIGINT) || '%)' || chr(10)
       || '<b>Resets:</b> ' || strftime(strptime(day, '%Y%m%d') + INTERVAL 1 DAY, '%Y-%m-%d') || 'T00:00:00.000Z' AS text
FROM f, (VALUES ('100'), ('200')) c(chat_id)
""")
def alerts_stream(spark, folder):
    """A message to each chat at the first event of a day and category that comes with the budget spent, worked off as a stream."""
    caps = {k: 300.0 for k in ("view", "signup", "click", "error", "purchase")}
    return stream_alerts(spark, folder, caps, _CHATS, {"click": "Clicks"})


# flows


def _chain(spark, folder):
    """Orders lead to customers, these to nations, and these to regions and, in a ring, to each other's region."""
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    orders, customers, nations = table(spark, folder, "orders"), table(spark, folder, "customer"), table(spark, folder, "nation")
    links = orders.select(key("o", "o_orderkey").alias("source"), key("c", "o_custkey").alias("target")).unionAll(customers.select(key("c", "c_custkey"), key("n", "c_nationkey"))).unionAll(nations.select(key("n", "n_nationkey"), key("r", "n_regionkey")))
    nodes = links.select(F.col("source").alias("id")).unionAll(links.select("target")).distinct()
    return nodes, links


_CHAIN = """
WITH RECURSIVE links AS (SELECT 'o' || o_orderkey AS source, 'c' || o_custkey AS target FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
up AS (SELECT DISTINCT target AS stop, target AS node, 0 AS distance FROM links WHERE target[1] = 'r' UNION SELECT stop, source, distance + 1 FROM up JOIN links ON target = node),
low AS (SELECT node, max(d) AS level FROM (WITH RECURSIVE down AS (SELECT DISTINCT source AS node, 0 AS d FROM links WHERE source NOT IN (SELECT target FROM links) UNION SELECT target, d + 1 FROM down JOIN links ON source = node) FROM down) GROUP BY 1)
"""


@query(_CHAIN + "SELECT stop, node AS id, CAST(level AS INTEGER) AS level, CAST(min(distance) AS INTEGER) AS distance FROM up JOIN low USING (node) GROUP BY 1, 2, 3")
def flow_run_order(spark, folder):
    """What has to run for each region as a stop node, in order of level."""
    nodes, links = _chain(spark, folder)
    return flows.run_order(nodes, links, nodes.filter("id like 'r%'"))[0]


@query("SELECT 'n' || n_nationkey AS id, CASE WHEN n_nationkey < 20 THEN 'cycle' ELSE 'behind a cycle' END AS problem FROM nation UNION ALL SELECT 'r' || r_regionkey, 'behind a cycle' FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)")
def flow_cycles(spark, folder):
    """Nations in rings of four, the last ones behind the first ring, and regions behind them."""
    key = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    n = F.col("n_nationkey")
    nation = table(spark, folder, "nation")
    ring = nation.filter("n_nationkey < 20").select(key("n", n).alias("source"), key("n", (n / 4).cast("int") * 4 + (n + 1) % 4).alias("target"))
    links = ring.unionAll(nation.filter("n_nationkey >= 20").select(F.lit("n0"), key("n", n))).unionAll(nation.select(key("n", n), key("r", F.col("n_regionkey"))))
    nodes = links.select(F.col("source").alias("id")).unionAll(links.select("target")).distinct()
    return flows.run_order(nodes, links, nodes.filter("id like 'r%'"))[1].select("id", "problem").distinct()


# registered operators and variables


@query()
def chunk_recursive_sql(spark, folder):
    """The recursive splitter as a table function."""
    registered.register(spark, ["split_recursive"])
    return spark.sql("SELECT d.doc_id, c.chunk_no, c.chunk FROM {docs} d, LATERAL split_recursive(d.text) c", docs=table(spark, folder, "documents").select("doc_id", "text"))


@query("SELECT 'two' AS run, vec_id FROM embeddings WHERE label = 2 UNION ALL SELECT 'five', vec_id FROM embeddings WHERE label = 5")
def variable_search(spark, folder):
    """One statement, run with two values of a session variable."""
    table(spark, folder, "embeddings").createOrReplaceTempView("larkspur_vectors")
    found = []
    for run, value in (("two", "2"), ("five", "5")):
        registered.set_variable(spark, "larkspur_tenant", value, "BIGINT")
        found.append(registered.with_variables(spark, "SELECT vec_id FROM larkspur_vectors WHERE label = ?", "larkspur_tenant").select(F.lit(run).alias("run"), "vec_id"))
    return found[0].unionAll(found[1])


@query(f"""
WITH v AS (SELECT vec_id, label, {_E} AS e FROM embeddings WHERE embedding IS NOT NULL),
p AS (SELECT a.vec_id AS q, a.e AS query, min(b.vec_id) AS expected FROM v a JOIN v b ON b.label = a.label AND b.vec_id <> a.vec_id WHERE a.vec_id % 10 = 0 GROUP BY 1, 2),
r AS (SELECT q, expected, vec_id, row_number() OVER (PARTITION BY q ORDER BY 1 - list_cosine_similarity(e, query), vec_id) AS rank FROM p, v WHERE vec_id <> q)
SELECT count(DISTINCT q) AS n, round(count(*) FILTER (vec_id = expected) / count(DISTINCT q), 9) AS recall FROM r WHERE rank <= 10
""")
def recall_at_10(spark, folder):
    """Of pairs of a query and an expected chunk (here the first other one of its label), how many have it among the ten nearest."""
    v = table(spark, folder, "embeddings").filter(vector_index.searchable("embedding")).select("vec_id", "label", "embedding")
    pairs = v.filter("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "label").join(v.select("vec_id", "label"), "label").filter("vec_id <> query_id").groupBy("query_id").agg(F.min("vec_id").alias("vec_id"))
    queries = pairs.select("query_id").join(v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")), "query_id")
    near = vector_index.exact(queries, v.select("vec_id", "embedding"), 11).filter("vec_id <> query_id")
    own = near.join(pairs.select("query_id"), "query_id", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).filter("rank <= 10")
    return vector_index.recall_of(own, pairs).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("recall"), 9).alias("recall"))


# fuzzy matches and tenants


@query("""
WITH p AS (SELECT lower(p_name || ' ' || p_brand) AS t, p_name || ' ' || p_brand AS class, count(*) AS copies FROM part GROUP BY 1, 2),
g AS (SELECT class, copies, list_distinct(list_transform(range(1, length(t) + 2), lambda i: substr('  ' || t || ' ', i, 3))) AS g FROM p),
l AS (SELECT a.class, sum(b.copies) AS others FROM g a JOIN g b ON a.class <> b.class AND len(list_intersect(a.g, b.g)) >= 0.6 * (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) - 1e-9 GROUP BY 1)
SELECT class, copies, CAST(copies - 1 + coalesce(others, 0) AS BIGINT) AS n_links FROM g LEFT JOIN l USING (class)
""")
def fuzzy_names(spark, folder):
    """Names with brands that are alike: all against all."""
    named = table(spark, folder, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("name"))
    return fuzzy.link_counts(named, "name", 0.6)


@query(f"SELECT vec_id, round(1 - list_cosine_similarity({_E}, {_Q}), 9) AS distance FROM embeddings WHERE label = 3 ORDER BY 1 - list_cosine_similarity({_E}, {_Q}), vec_id LIMIT 5")
def tenant_search(spark, folder):
    """The nearest vectors of one tenant (a label), read from its own folder."""
    path = shared_folder(spark)
    tenants.write(table(spark, folder, "embeddings"), path, "label")
    found = tenants.top_k(spark, path, "label", 3, first_vector(spark, folder), 5)
    return found.select("vec_id", F.round("distance", 9).alias("distance"))


# refreshes


@query("""
WITH h AS (SELECT sha256(length(CAST(doc_id AS VARCHAR)) || ':' || doc_id || coalesce(length(text) || ':' || text, '-') || '-') AS h FROM documents),
b AS (SELECT substr(h, 1, 3) AS b, sha256(string_agg(h, ':' ORDER BY h)) AS d FROM h GROUP BY 1),
t AS (SELECT sha256(string_agg(d, ':' ORDER BY d)) AS digest FROM b)
SELECT 'first' AS run, digest, false AS skipped, (SELECT count(*) FROM documents) AS upserted FROM t UNION ALL SELECT 'same', digest, true, 0 FROM t
""")
def refresh_skip(spark, folder):
    """A snapshot is refreshed once; the same one again is skipped by its digest before any chunk is made."""
    items = table(spark, folder, "documents").select(F.col("doc_id").alias("external_id"), F.col("doc_id").alias("pos"), F.col("text").alias("content"), F.lit(None).cast("string").alias("visual_description"))
    mapping = items.limit(0).select("external_id", F.lit("").alias("doc_id"))
    stored = items.limit(0).select(F.col("external_id").alias("source_id"), F.lit("").alias("doc_id"), F.lit(0).alias("chunk_no"), F.lit("").alias("chunk"), F.lit("").alias("hash"))
    first, digest = refresh.refresh_snapshot(items, mapping, stored, None)
    again, same = refresh.refresh_snapshot(items.orderBy(F.desc("external_id")), mapping, stored, digest)
    row = lambda run, d, skipped: [F.lit(run).alias("run"), F.lit(d).alias("digest"), F.lit(skipped).alias("skipped")]
    done = first.counters.select(*row("first", digest, first is None), "upserted")
    return done.unionByName(spark.range(1).select(*row("same", same, again is None), F.lit(0).cast("bigint").alias("upserted")))


@query("""
WITH stored AS (SELECT DISTINCT doc_id % 50 AS source_id, sha256(coalesce(length(text) || ':' || text, '-')) AS hash FROM documents WHERE doc_id % 5 <> 0),
incoming AS (SELECT DISTINCT doc_id % 50 AS source_id, sha256(coalesce(length(text) || ':' || text, '-')) AS hash FROM documents WHERE doc_id % 3 <> 0),
j AS (SELECT coalesce(o.source_id, n.source_id) AS source_id, o.hash AS oh, n.hash AS nh FROM (SELECT * FROM stored WHERE source_id IN (SELECT source_id FROM incoming)) o FULL JOIN incoming n ON o.source_id = n.source_id AND o.hash = n.hash)
SELECT source_id, count(*) FILTER (oh IS NULL) AS num_added, count(*) FILTER (oh IS NOT NULL AND nh IS NOT NULL) AS num_updated, 0::BIGINT AS num_skipped, count(*) FILTER (nh IS NULL) AS num_deleted FROM j GROUP BY source_id
""")
def upsert_forced(spark, folder):
    """Counts of an upsert that writes again what is there already."""
    docs = table(spark, folder, "documents").select((F.col("doc_id") % 50).alias("source_id"), "doc_id", merge.content_hash("text").alias("hash"))
    return merge.upsert_counts(merge.delta(docs.filter("doc_id % 5 <> 0").select("source_id", "hash"), docs.filter("doc_id % 3 <> 0").select("source_id", "hash"), force_update=True))
