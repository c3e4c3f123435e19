"""The engine's own queries, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagitta.functions import records, text, udfs
from sagitta.functions import vectors as V
from sagitta.operators import collections, filters, graph, history, index, quantize, replication, ring, search
from sagitta.plans import dialects
from sagitta.sources import formats
from sagitta.sources.files import temporary
from sagitta.streaming import changes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def with_payload(spark: SparkSession, sf: str) -> DataFrame:
    return points(spark, sf).withColumn("payload", F.parse_json(F.to_json(F.struct("label"))))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("payload", F.parse_json("props"))


def query_vector(spark: SparkSession, sf: str, vec_id: int = 0) -> list[float]:
    return [float(x) for x in table(spark, sf, "embeddings").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


# nearest neighbours

D = "e.embedding::DOUBLE[]"
Q0 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)"
MEASURES = {
    "cosine": (f"list_cosine_similarity({D}, {Q0})", "DESC"),
    "dot": (f"list_inner_product({D}, {Q0})", "DESC"),
    "l2": (f"list_distance({D}, {Q0})", "ASC"),
    "l1": ("(SELECT sum(abs(x - y)) FROM (SELECT unnest(e.embedding)::DOUBLE AS x, unnest((SELECT embedding FROM embeddings WHERE vec_id = 0))::DOUBLE AS y))", "ASC"),
}


def nearest_sql(metric: str, where: str = "true", limit: int = 10, offset: int = 0, having: str = "true") -> str:
    value, order = MEASURES[metric]
    return f"""WITH s AS (SELECT vec_id AS id, {value} AS score FROM embeddings e WHERE {where})
SELECT row_number() OVER (ORDER BY score {order}, id)::INT AS rank, id, round(score, 4) AS score FROM s WHERE {having}
QUALIFY rank > {offset} AND rank <= {offset + limit}"""


def nearest(spark: SparkSession, sf: str, **options) -> DataFrame:
    found = search.search(with_payload(spark, sf), search.Request(query_vector(spark, sf), **options))
    return found.select("rank", "id", F.round("score", 4).alias("score"))


for _metric in MEASURES:
    query(f"knn_{_metric}", nearest_sql(_metric))(lambda spark, sf, m=_metric: nearest(spark, sf, metric=m))

query("knn_filtered", nearest_sql("cosine", "label = 3"))(lambda spark, sf: nearest(spark, sf, filter=filters.Filter(must=[filters.Match("label", 3)])))
query("knn_threshold_offset", nearest_sql("cosine", "label <> 3", 5, 2, "score >= 0.0"))(
    lambda spark, sf: nearest(spark, sf, filter=filters.Filter(must_not=[filters.MatchInteger("label", 3)]), threshold=0.0, limit=5, offset=2))
query("knn_json_request", nearest_sql("l2", "label >= 2 AND label < 6", 7))(
    lambda spark, sf: search.search(with_payload(spark, sf), dialects.json_search({"vector": query_vector(spark, sf), "limit": 7, "metric": "L2", "filter": {"must": {"key": "label", "range": {"gte": 2, "lt": 6}}}})).select("rank", "id", F.round("score", 4).alias("score")))


@query("knn_graph_query", nearest_sql("cosine", limit=4).replace("round(score, 4) AS score", "round(score, 4) AS certainty, round(1 - score, 4) AS distance"))
def _(spark, sf):
    q = ", ".join(map(str, query_vector(spark, sf)))
    asked = dialects.graph_query(f"{{ Get {{ Point(nearVector: {{vector: [{q}]}}, limit: 4) {{ label _additional {{ id distance certainty }} }} }} }}")
    return search.search(with_payload(spark, sf), asked.request()).select("rank", "id", F.round("score", 4).alias("certainty"), F.round("distance", 4).alias("distance"))


def batch_sql(limit: int, same: str = "true") -> str:
    return f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity({D}, q.embedding::DOUBLE[]) AS score
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND {same})
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank, id, round(score, 4) AS score FROM s QUALIFY rank <= {limit}"""


def batched(spark: SparkSession, sf: str, limit: int, **options) -> DataFrame:
    queries = points(spark, sf).where(F.col("id") % 100 == 0).withColumnRenamed("id", "query_id")
    return search.search_batch(points(spark, sf), queries, limit, **options).select("query_id", "rank", "id", F.round("score", 4).alias("score"))


query("knn_batch", batch_sql(10))(lambda spark, sf: batched(spark, sf, 10))
query("knn_by_label", batch_sql(3, "q.label = e.label AND q.vec_id <> e.vec_id"))(lambda spark, sf: batched(spark, sf, 3, by="label", skip_self=True))


@query("explore_union", f"""WITH s AS (SELECT 'c' || label AS collection, vec_id AS id, list_cosine_similarity({D}, {Q0}) AS score FROM embeddings e WHERE label < 3)
SELECT row_number() OVER (ORDER BY score DESC, collection, id)::INT AS rank, collection, id, round(score, 4) AS score FROM s QUALIFY rank <= 8""")  # fmt: skip
def _(spark, sf):
    rows = points(spark, sf)
    parts = {f"c{k}": rows.where(F.col("label") == k) for k in range(3)}
    return search.explore(parts, search.Request(query_vector(spark, sf), 8)).select("rank", "collection", "id", F.round("score", 4).alias("score"))


@query("hybrid_search", """WITH s AS (SELECT d.doc_id AS id, 0.5 * list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0))
    + 0.5 * (contains(lower(text), 'der')::INT + contains(lower(text), 'nation')::INT) / 2 AS score FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id)
SELECT id, round(score, 4) AS score FROM s ORDER BY s.score DESC, id LIMIT 10""")  # fmt: skip
def _(spark, sf):
    rows = table(spark, sf, "documents").join(points(spark, sf), F.col("doc_id") == F.col("id"))
    return search.hybrid(rows, query_vector(spark, sf), ["der", "nation"]).select("id", F.round("score", 4).alias("score"))


@query("fused_search", """WITH q AS (SELECT list_transform(range(1, 65), lambda i: 0.7 * a.embedding[i]::DOUBLE + 0.3 * b.embedding[i]::DOUBLE) AS v
  FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id = 1)
SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], v), 4) AS score FROM embeddings, q ORDER BY list_cosine_similarity(embedding::DOUBLE[], v) DESC, vec_id LIMIT 10""")  # fmt: skip
def _(spark, sf):
    found = search.fused(points(spark, sf), [query_vector(spark, sf, 0), query_vector(spark, sf, 1)], [0.7, 0.3])
    return found.select("id", F.round("score", 4).alias("score"))


@query("custom_similarity", "SELECT vec_id AS id, round(greatest(0, 1 - abs(embedding[1]::DOUBLE - q)), 4) AS score FROM embeddings, (SELECT embedding[1]::DOUBLE AS q FROM embeddings WHERE vec_id = 0) ORDER BY greatest(0, 1 - abs(embedding[1]::DOUBLE - q)) DESC, vec_id LIMIT 10")
def _(spark, sf):
    return search.custom(points(spark, sf), query_vector(spark, sf), udfs.function("builtin", "custom_similarity")).select("id", F.round("score", 4).alias("score"))


@query("vectorised_udf", f"SELECT vec_id AS id, round(list_inner_product({D}, {Q0}), 4) AS score FROM embeddings e")
def _(spark, sf):
    f = udfs.vectorised(lambda a, b: np.einsum("ij,ij->i", a, b))
    return points(spark, sf).select("id", F.round(f("vector", V.column(query_vector(spark, sf))), 4).alias("score"))


# functions of vectors


@query("vector_functions", f"""SELECT vec_id AS id, len(embedding)::INT AS dim, round(sqrt(list_inner_product({D}, {D})), 4) AS norm, round(list_distance({D}, {Q0}) ** 2, 3) AS squared,
  round(list_sum(list_transform({D}, lambda x: x * 2)), 3) AS doubled, round(1 - list_cosine_similarity({D}, {Q0}), 4) AS distance,
  round(list_sum(list_transform({D}, lambda x: abs(x))) / sqrt(list_inner_product({D}, {D})), 4) AS unit_l1 FROM embeddings e""")  # fmt: skip
def _(spark, sf):
    q = query_vector(spark, sf)
    unit = V.normalize("vector")
    return points(spark, sf).select(
        "id", V.dim("vector").alias("dim"), F.round(V.norm("vector"), 4).alias("norm"), F.round(V.squared_l2("vector", q), 3).alias("squared"), F.round(V.total(V.add("vector", "vector")), 3).alias("doubled"),
        F.round(V.calculate("COSINE", "vector", q), 4).alias("distance"), F.round(V.manhattan(unit, V.zeros(64)), 4).alias("unit_l1"))


@query("similarity_stats", f"SELECT round(avg(s), 4) AS mean, round(min(s), 4) AS least, round(max(s), 4) AS most FROM (SELECT list_cosine_similarity({D}, {Q0}) AS s FROM embeddings e)")
def _(spark, sf):
    return search.similarity_stats(points(spark, sf), query_vector(spark, sf)).select(*(F.round(c, 4).alias(c) for c in ("mean", "least", "most")))


@query("text_vectors", "SELECT doc_id, round(list_sum(list_transform(range(1, 513), lambda i: CASE WHEN i <= length(text) THEN (unicode(text[i]) + i - 1) / 1000.0 ELSE 0 END)), 4)::DOUBLE AS total FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.round(V.total(V.text_vector("text")), 4).alias("total"))


# filters and pages


@query("filter_tree", """SELECT event_id, event_type FROM events WHERE event_type = 'click' AND CAST(json_extract(props, '$.k') AS BIGINT) >= 3
  AND (CAST(json_extract(props, '$.k') AS BIGINT) = 4 OR CAST(json_extract(props, '$.k') AS BIGINT) > 6) AND CAST(json_extract(props, '$.k') AS BIGINT) <> 8""")  # fmt: skip
def _(spark, sf):
    tree = dialects.json_filter({"must": [{"key": "k", "range": {"gte": 3}}], "should": [{"key": "k", "match": {"value": 4}}, {"filter": {"must": [{"key": "k", "range": {"gt": 6}}]}}], "must_not": [{"key": "k", "match": {"any": [8]}}, {"key": "none", "match": {"text": "x"}}]})
    return filters.where(events(spark, sf).where("event_type = 'click'"), tree).select("event_id", "event_type")


@query("filter_not_missing", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    tree = filters.Filter(must_not=[filters.Match("absent", 1), filters.Match("k", "3")])
    return filters.where(events(spark, sf), tree).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("metadata_algebra", """SELECT p_partkey FROM part WHERE p_retailprice >= 1000 AND p_retailprice < 1500 AND p_brand <> 'Brand#11' AND (p_size IN (1, 5, 9) OR contains(p_type, 'STEEL') OR p_name = 'x')""")
def _(spark, sf):
    meta = F.create_map(F.lit("price"), F.col("p_retailprice").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string"), F.lit("type"), F.col("p_type"))
    test = filters.all_of(filters.gte("price", 1000), filters.lt("price", 1500), filters.ne("brand", "Brand#11"), filters.ne("none", "x"), filters.any_of(filters.among("size", ["1", "5", "9"]), filters.contains("type", "STEEL")))
    return table(spark, sf, "part").where(test.column(meta)).select("p_partkey")


query("filter_expression", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND (c_acctbal > 5000 OR c_nationkey = 3) AND NOT (c_custkey <= 10)")(
    lambda spark, sf: table(spark, sf, "customer").where(dialects.expression('c_mktsegment in ["BUILDING", "MACHINERY"] and (c_acctbal > 5000 or c_nationkey == 3) and not (c_custkey <= 10)')).select("c_custkey"))
query("scroll_page", "SELECT c_custkey, c_name FROM customer WHERE c_custkey >= 20 AND c_acctbal > 0 ORDER BY 1 LIMIT 15")(
    lambda spark, sf: search.scroll(table(spark, sf, "customer"), 15, 20, F.col("c_acctbal") > 0, "c_custkey")[0].select("c_custkey", "c_name"))
query("retrieve_ids", "SELECT i::INT AS ordinal, id, label FROM (SELECT vec_id AS id, label, list_position([7, 3, 999999, 11], vec_id) AS i FROM embeddings) WHERE i > 0")(
    lambda spark, sf: search.retrieve(points(spark, sf), [7, 3, 999_999, 11]).select(F.col("ordinal").cast("int").alias("ordinal"), "id", "label"))
query("count_filtered", "SELECT count(*) AS count FROM embeddings WHERE label IN (1, 2)")(lambda spark, sf: search.count(with_payload(spark, sf), filters.MatchAny("label", [1, 2])))
query("selectivity", "SELECT avg(CASE WHEN label = 4 THEN 1.0 ELSE 0.0 END) AS selectivity FROM embeddings")(lambda spark, sf: search.selectivity(with_payload(spark, sf), filters.Match("label", 4)))
query("inverted_index", "SELECT 'label' AS field, label::VARCHAR AS value, vec_id // 100000 AS block, list_sort(list(DISTINCT vec_id)) AS ids FROM embeddings GROUP BY ALL")(
    lambda spark, sf: search.inverted_index(points(spark, sf).withColumn("metadata", F.create_map(F.lit("label"), F.col("label").cast("string")))))
query("projection", "SELECT vec_id AS id, '{\"label\":' || label || '}' AS payload FROM embeddings")(
    lambda spark, sf: points(spark, sf).select("id", F.to_json(filters.projected(F.parse_json(F.to_json(F.struct("label", "id"))), include=["label"])).alias("payload")))

# points that change


@query("upsert_latest", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1")
def _(spark, sf):
    return collections.latest(table(spark, sf, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("upsert_delete", """SELECT vec_id AS id, CASE WHEN vec_id % 5 = 0 THEN label + 100 ELSE label END AS label FROM embeddings WHERE vec_id % 7 <> 0""")
def _(spark, sf):
    old = points(spark, sf).select("id", "label")
    new = old.where("id % 5 = 0").withColumn("label", F.col("label") + 100)
    return collections.deleted(collections.upserted(old, new), old.where("id % 7 = 0"))


@query("compaction", """WITH runs AS (SELECT vec_id AS id, label, false AS deleted, 0 AS run FROM embeddings UNION ALL SELECT vec_id, label + 1, false, 1 FROM embeddings WHERE vec_id % 2 = 0
  UNION ALL SELECT vec_id, NULL, true, 2 FROM embeddings WHERE vec_id % 3 = 0)
SELECT id, label FROM runs QUALIFY row_number() OVER (PARTITION BY id ORDER BY run DESC) = 1 AND NOT deleted""")  # fmt: skip
def _(spark, sf):
    base = points(spark, sf).select("id", "label").withColumn("deleted", F.lit(False))
    runs = [base, base.where("id % 2 = 0").withColumn("label", F.col("label") + 1), base.where("id % 3 = 0").withColumns({"label": F.lit(None).cast("int"), "deleted": F.lit(True)})]
    return collections.compacted(runs).select("id", "label")


@query("collection_lifecycle", "SELECT vec_id AS id, len(embedding)::INT AS dim, CASE WHEN vec_id < 5 THEN 'new' ELSE 'old' END AS tag FROM embeddings WHERE vec_id <> 3")
def _(spark, sf):
    c = collections.Catalog(spark, temporary(spark, "catalog")).create("points", 64)
    rows = points(spark, sf).select("id", "vector", F.lit('{"tag":"old"}').alias("payload"))
    c.upsert(rows)
    name = c.snapshot()
    c.delete(condition=filters.Match("tag", "old"))
    c.restore(name)
    c.upsert(rows.where("id < 5").withColumn("payload", F.lit('{"tag":"new"}')))
    c.delete([3])
    return c.scan().select("id", F.size("vector").alias("dim"), F.try_variant_get("payload", "$.tag", "string").alias("tag"))


@query("conditional_update", "SELECT vec_id AS id, round(CASE WHEN vec_id = 2 THEN 0.0 ELSE list_sum(embedding::DOUBLE[]) END, 3) AS total FROM embeddings")
def _(spark, sf):
    rows = collections.replaced_if(points(spark, sf), 2, query_vector(spark, sf, 2), [0.0] * 64)
    rows = collections.replaced_if(rows, 1, query_vector(spark, sf, 2), [0.0] * 64)
    return rows.select("id", F.round(V.total(F.transform("vector", lambda x: x.cast("double"))), 3).alias("total"))


# histories and aggregations

PLACE = "list_sort(list(value))[least(floor(count(*) * {q})::BIGINT, count(*) - 1) + 1]"


@query("latency_stats", "SELECT event_type, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, " + ", ".join(f"{PLACE.format(q=q)} AS p{int(q * 100)}" for q in (0.5, 0.95, 0.99)) + " FROM events GROUP BY 1")
def _(spark, sf):
    return history.statistics(table(spark, sf, "events"), "value", ["event_type"]).withColumn("mean", F.round("mean", 6))


query("op_error_rates", """SELECT user_id, count(*) AS total, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS successes,
  count(*) FILTER (event_type = 'error') / count(*) AS error_rate, count(*) FILTER (event_type = 'purchase') / count(*) AS success_rate FROM events GROUP BY 1""")(
    lambda spark, sf: history.rates(table(spark, sf, "events"), "user_id", F.col("event_type") == "error", F.col("event_type") == "purchase"))
query("op_counts", "SELECT event_type, count(*) AS count FROM events GROUP BY 1")(lambda spark, sf: history.counts(table(spark, sf, "events"), "event_type"))
query("keyed_operations", "SELECT k AS key, count(*) AS n FROM (SELECT DISTINCT event_id, unnest([user_id, user_id % 10]) AS k FROM events) GROUP BY 1")(
    lambda spark, sf: history.by_key(table(spark, sf, "events").withColumn("keys", F.array("user_id", F.col("user_id") % 10)), "keys").groupBy("key").agg(F.count(F.lit(1)).alias("n")))
query("latency_histogram", "SELECT b AS bound, (SELECT count(*) FROM events WHERE b IS NULL OR value <= b) AS count FROM (SELECT unnest([" + ", ".join(map(str, history.BOUNDS)) + ", NULL])::DOUBLE AS b)")(
    lambda spark, sf: history.histogram(table(spark, sf, "events"), "value"))


@query("tumbling_throughput", """WITH m AS (SELECT min(epoch_us(ts)) AS a, max(epoch_us(ts)) AS b FROM events), w AS (SELECT unnest(range(0, (b - a) // 3600000000 + 1)) AS no, a FROM m),
c AS (SELECT (epoch_us(ts) - a) // 3600000000 AS no, count(*) AS n FROM events, m GROUP BY 1)
SELECT make_timestamp(a + no * 3600000000) AS start, coalesce(n, 0) AS count, round(coalesce(n, 0) / 3600.0::DOUBLE, 8) AS rate FROM w LEFT JOIN c USING (no)""")  # fmt: skip
def _(spark, sf):
    return history.throughput(table(spark, sf, "events"), "ts", 3600).withColumns({"start": F.col("start").cast("timestamp_ntz"), "rate": F.round("rate", 8)})


@query("overlap_groups", """WITH i AS (SELECT user_id, epoch_us(ts) AS s, epoch_us(ts) + (value * 10000000)::BIGINT AS e FROM events),
m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM i),
g AS (SELECT *, sum(CASE WHEN p IS NULL OR s >= p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
SELECT user_id, min(s) AS start, max(e) AS end, count(*) AS size FROM g GROUP BY user_id, g HAVING count(*) > 1""")  # fmt: skip
def _(spark, sf):
    s = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = table(spark, sf, "events").select("user_id", s.alias("s"), (s + F.round(F.col("value") * 10_000_000).cast("long")).alias("e"))
    return history.overlapping(rows, "user_id", "s", "e")


@query("rolling_p95", """WITH r AS (SELECT event_id, event_type, list_sort(list(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 99 PRECEDING)) AS v FROM events)
SELECT event_id, v[least(floor(len(v) * 0.95)::BIGINT, len(v) - 1) + 1] AS rolling FROM r""")  # fmt: skip
def _(spark, sf):
    return history.rolling_quantile(table(spark, sf, "events"), "value", ["ts", "event_id"], "event_type", 100).select("event_id", "rolling")


@query("rate_window", """WITH r AS (SELECT event_id, epoch_us(ts) AS a, value AS v, min(struct_pack(a := epoch_us(ts), v := value)) OVER
  (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS f FROM events)
SELECT event_id, round(CASE WHEN a - f.a > 0 THEN (v - f.v) / ((a - f.a) / 1e6::DOUBLE) ELSE 0 END, 6) AS rate FROM r""")  # fmt: skip
def _(spark, sf):
    return history.window_rate(table(spark, sf, "events"), "ts", "value", "user_id", 86400).select("event_id", F.round("rate", 6).alias("rate"))


query("ordering_check", "WITH l AS (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT event_id, value, before FROM l WHERE value < before")(
    lambda spark, sf: history.out_of_order(table(spark, sf, "events"), "user_id", "event_id", "value").select("event_id", "value", "before"))
query("process_sequences", """WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
SELECT user_id, (k - 1) // 10000 AS no, min(k) AS first, count(*) AS count, list(event_id ORDER BY k) AS ops FROM n GROUP BY ALL""")(lambda spark, sf: history.sequences(table(spark, sf, "events"), "user_id", "ts", "event_id"))


@query("read_after_write_check", """WITH l AS (SELECT event_id, event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events)
SELECT event_id FROM l WHERE b IN ('purchase', 'signup') AND event_type IN ('view', 'click') AND NOT value > 10""")  # fmt: skip
def _(spark, sf):
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "write").when(F.col("event_type").isin("view", "click"), "read").otherwise("other")
    return history.stale_reads(table(spark, sf, "events").withColumns({"kind": kind, "ok": F.col("value") > 10}), "user_id", "event_id", "kind", "ok").select("event_id")


@query("register_check", """WITH h AS (SELECT event_id, user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN 'write' ELSE 'read' END AS kind, floor(value) % 3 AS v FROM events),
l AS (SELECT *, last_value(CASE WHEN kind = 'write' THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS x FROM h)
SELECT event_id, x AS expected FROM l WHERE kind = 'read' AND v IS DISTINCT FROM x""")  # fmt: skip
def _(spark, sf):
    kind = F.when(F.col("event_type").isin("purchase", "signup"), "write").otherwise("read")
    rows = table(spark, sf, "events").withColumns({"kind": kind, "v": (F.floor("value") % 3).cast("double")})
    return history.register_violations(rows, "user_id", ["event_id"], "kind", "v").select("event_id", "expected")


query("transaction_conflicts", "WITH t AS (SELECT DISTINCT l_orderkey, l_partkey AS key FROM lineitem) SELECT key, l_orderkey, min(l_orderkey) OVER (PARTITION BY key) AS first, count(*) OVER (PARTITION BY key) - 1 AS others FROM t QUALIFY others > 0")(
    lambda spark, sf: history.cliques(table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("keys")), "l_orderkey", "keys"))
query("history_filter", "SELECT event_id FROM events WHERE event_type IN ('view', 'error') AND ts >= (SELECT min(ts) FROM events) + INTERVAL 1 DAY AND ts <= (SELECT min(ts) FROM events) + INTERVAL 3 DAY AND user_id = 5")(
    lambda spark, sf: _history_filter(table(spark, sf, "events")))


def _history_filter(rows: DataFrame) -> DataFrame:
    import datetime

    first = rows.agg(F.min("ts")).first()[0]
    return history.selected(rows, ["view", "error"], first + datetime.timedelta(days=1), first + datetime.timedelta(days=3), 5, columns={"kind": "event_type", "time": "ts", "process": "user_id"}).select("event_id")


HASH = "CAST('0x' || substr(md5({}::VARCHAR), 1, 8) AS BIGINT)"


def ring_sql(nodes: int) -> str:
    return f"""ring AS (SELECT 'node' || n AS node, {HASH.format("'node' || n || '#' || k")} AS pos FROM range({nodes}) a(n), range({ring.REPLICAS}) b(k)),
found AS (SELECT event_id, coalesce(r.node, (SELECT arg_min(node, pos) FROM ring)) AS node FROM (SELECT event_id, {HASH.format("event_id")} AS h FROM events) e ASOF LEFT JOIN ring r ON e.h <= r.pos)"""


def nodes(n: int) -> list[str]:
    return [f"node{k}" for k in range(n)]


query("ring_distribution", f"WITH {ring_sql(8)} SELECT node, count(*) AS n FROM found GROUP BY 1")(lambda spark, sf: ring.Ring(nodes(8)).distribution(table(spark, sf, "events"), "event_id"))
query("ring_moves", f"WITH b AS (WITH {ring_sql(8)} SELECT * FROM found), a AS (WITH {ring_sql(9)} SELECT * FROM found) SELECT b.node AS old, a.node AS new, count(*) AS n FROM a JOIN b USING (event_id) WHERE a.node <> b.node GROUP BY ALL")(
    lambda spark, sf: ring.Ring(nodes(9)).assigned(ring.Ring(nodes(8)).assigned(table(spark, sf, "events"), "event_id", "old"), "event_id", "new").where("old != new").groupBy("old", "new").agg(F.count(F.lit(1)).alias("n")))
query("hash_partition_stats", f"WITH n AS (SELECT {HASH.format('user_id')} % 16 AS node, count(*) AS n FROM events GROUP BY 1) SELECT count(*) AS nodes, min(n) AS min, max(n) AS max, round(avg(n), 4) AS mean, round(stddev_pop(n), 4) AS deviation FROM n")(
    lambda spark, sf: history.distribution(table(spark, sf, "events"), history.shard(F.col("user_id"), 16)).withColumns({"mean": F.round("mean", 4), "deviation": F.round("deviation", 4)}))
LIMITED = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events),
w AS (SELECT user_id, min(t) AS s FROM e GROUP BY 1 UNION ALL SELECT w.user_id, min(e.t) AS s FROM w JOIN e ON e.user_id = w.user_id AND e.t >= w.s + 3600000000 GROUP BY w.user_id, w.s),
p AS (SELECT e.event_id, e.user_id, e.t, w.s FROM e ASOF JOIN w ON e.user_id = w.user_id AND e.t >= w.s),
l AS (SELECT event_id, user_id, t, row_number() OVER (PARTITION BY user_id, s ORDER BY t, event_id) <= 5 AS allowed FROM p) """
query("rate_limiter", LIMITED + "SELECT event_id, allowed FROM l")(lambda spark, sf: history.window_limited(table(spark, sf, "events"), "user_id", "ts", 5, 3600, "event_id").select("event_id", "allowed"))
_kinds = list(history.WORKLOAD)
_bounds = [sum(list(history.WORKLOAD.values())[: k + 1]) for k in range(len(_kinds))]
_draw = f"({HASH.format(chr(39) + '0:{}:' + chr(39) + ' || id')} / 4294967296.0::DOUBLE)"
query("workload", f"SELECT CASE {' '.join(f'WHEN d < {b!r}::DOUBLE THEN {k!r}' for k, b in zip(_kinds, _bounds, strict=True))} ELSE 'read' END AS kind, count(*) AS n FROM (SELECT {_draw.format(0)} * {sum(history.WORKLOAD.values())!r}::DOUBLE AS d FROM range(1000) r(id)) GROUP BY 1")(lambda spark, sf: history.workload(spark, 1000).groupBy("kind").agg(F.count(F.lit(1)).alias("n")))
query("trace_sampling", f"SELECT event_id FROM events WHERE {HASH.format('event_id')} % 10000 < 2500")(lambda spark, sf: table(spark, sf, "events").where(history.sampled(F.col("event_id"), 0.25)).select("event_id"))

# change streams and replication

query("cdc_sequence", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS sequence FROM events")(
    lambda spark, sf: changes.sequenced(table(spark, sf, "events"), "event_type", ["ts", "event_id"]).select("event_id", "event_type", "sequence"))


@query("cdc_latest", "WITH l AS (SELECT event_type AS collection, user_id AS vector_id, arg_max(event_id, event_id) AS sequence, arg_max(event_id % 4 = 3, event_id) AS gone FROM events GROUP BY ALL) SELECT collection, vector_id, sequence FROM l WHERE NOT gone")
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("collection"), F.col("user_id").alias("vector_id"), F.when(F.col("event_id") % 4 == 3, "delete").otherwise("update").alias("change_type"), F.array().cast("array<float>").alias("vector"), F.col("event_id").alias("sequence"))
    return changes.state(rows).select("collection", "vector_id", "sequence")


@query("cdc_difference", "SELECT vec_id AS vector_id, CASE WHEN vec_id % 11 = 0 THEN 'delete' ELSE 'update' END AS change_type, row_number() OVER (ORDER BY vec_id) - 1 AS sequence FROM embeddings WHERE vec_id % 11 = 0 OR vec_id % 13 = 0")
def _(spark, sf):
    before = points(spark, sf).select("id", "vector")
    after = before.where("id % 11 != 0").withColumn("vector", F.when(F.col("id") % 13 == 0, F.array(F.lit(1.0).cast("float"))).otherwise(F.col("vector")))
    return changes.difference(before, after, "c").select("vector_id", "change_type", "sequence")


def streamed(spark: SparkSession, sf: str, make) -> DataFrame:
    """The rows that a stream over the events gives when all of them have come in."""
    rows = table(spark, sf, "events")
    stream = make(spark.readStream.schema(rows.schema).parquet(f"{sf}/events.parquet*"))
    out = temporary(spark, "stream")
    q = stream.writeStream.format("parquet").option("checkpointLocation", temporary(spark, "checkpoint")).outputMode("append").trigger(availableNow=True).start(out)
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def summed_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Windowed counts of a stream over the events; complete output, so that the last windows count too."""
    rows = table(spark, sf, "events")
    stream = changes.tumbling(spark.readStream.schema(rows.schema).parquet(f"{sf}/events.parquet*"), "ts", "1 day", "event_type")
    out = temporary(spark, "stream")
    keep = lambda batch, _: batch.write.mode("overwrite").parquet(out)
    stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", temporary(spark, "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


query("stream_tumbling", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS count FROM events GROUP BY ALL")(summed_stream)
query("stream_limiter", LIMITED + "SELECT user_id, make_timestamp(t) AS at, allowed FROM l")(
    lambda spark, sf: streamed(spark, sf, lambda s: changes.limited(s.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", 5, 3600)).withColumn("at", F.col("at").cast("timestamp_ntz")))
query("session_windows", """WITH l AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM l)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS end, count(*) AS count FROM g GROUP BY user_id, g""")(
    lambda spark, sf: changes.sessions(table(spark, sf, "events"), "ts", "1 hour", "user_id").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}))


def operations(spark: SparkSession, sf: str) -> DataFrame:
    """Operations of two regions on keys, from the events: op_id, key, kind, region, time and clock."""
    clock = F.create_map(F.lit("a"), F.col("event_id") % 7, F.lit("b"), F.floor(F.col("event_id") / 7) % 5)
    kind = F.when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "signup", "insert").otherwise("update")
    return table(spark, sf, "events").select(F.col("event_id").alias("op_id"), (F.col("user_id") % 50).alias("key"), kind.alias("kind"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("region"), F.col("ts").alias("time"), clock.alias("clock"))


query("vector_clock_compare", """SELECT event_id, CASE WHEN (x < 3 AND y > 2) OR (x > 3 AND y < 2) THEN 'Concurrent' WHEN x < 3 OR y < 2 THEN 'Less' WHEN x > 3 OR y > 2 THEN 'Greater' ELSE 'Equal' END AS relation,
  greatest(x, 3) AS a, greatest(y, 2) AS b FROM (SELECT event_id, event_id % 7 AS x, event_id // 7 % 5 AS y FROM events)""")(
    lambda spark, sf: _clocks(operations(spark, sf)))


def _clocks(rows: DataFrame) -> DataFrame:
    other = F.create_map(F.lit("a"), F.lit(3).cast("long"), F.lit("b"), F.lit(2).cast("long"))
    both = replication.merged(F.col("clock"), other)
    return rows.select(F.col("op_id").alias("event_id"), replication.compared(F.col("clock"), other).alias("relation"), both["a"].alias("a"), both["b"].alias("b"))


query("conflict_pairs", """WITH o AS (SELECT min(event_id) AS id, count(*) AS n, user_id % 50 AS key, event_id % 7 AS a, event_id // 7 % 5 AS b FROM events WHERE event_type <> 'signup' GROUP BY ALL)
SELECT x.id AS a, y.id AS b, x.key, x.n AS a_ops, y.n AS b_ops FROM o x JOIN o y ON x.key = y.key AND x.id < y.id WHERE (x.a < y.a AND x.b > y.b) OR (x.a > y.a AND x.b < y.b)""")(
    lambda spark, sf: replication.conflicts(operations(spark, sf)))
query("lww_resolve", "SELECT user_id % 50 AS key, arg_max(event_id, (ts, event_id)) AS op_id FROM events GROUP BY 1")(lambda spark, sf: replication.resolved(operations(spark, sf)).select("key", "op_id"))
query("fww_resolve", "SELECT user_id % 50 AS key, arg_max(event_id, (-epoch_us(ts), event_id)) AS op_id FROM events GROUP BY 1")(lambda spark, sf: replication.resolved(operations(spark, sf), "first").select("key", "op_id"))
query("priority_resolve", "SELECT user_id % 50 AS key, arg_max(event_id, (event_id % 2, ts, event_id)) AS op_id FROM events GROUP BY 1")(lambda spark, sf: replication.resolved(operations(spark, sf), "priority", priority={"a": 1, "b": 2}).select("key", "op_id"))
query("clock_merge", "SELECT user_id % 50 AS key, max(event_id % 7) AS a, max(event_id // 7 % 5) AS b FROM events GROUP BY 1")(
    lambda spark, sf: replication.merged_clocks(operations(spark, sf)).select("key", F.col("clock")["a"].alias("a"), F.col("clock")["b"].alias("b")))
query("partition_gaps", "WITH l AS (SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events) SELECT user_id, b AS start, ts AS end FROM l WHERE ts - b > INTERVAL 10800 SECOND")(
    lambda spark, sf: replication.silent(table(spark, sf, "events"), "user_id", "ts", 3600))

# quantisers and indexes

LOHI = """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), b AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM x GROUP BY 1) """


def spans(spark: SparkSession, sf: str) -> tuple[list[float], list[float]]:
    return tuple(quantize.bounds(points(spark, sf)).first())


query("component_bounds", LOHI + "SELECT pos::INT - 1 AS pos, round(lo, 6) AS lo, round(hi, 6) AS hi FROM b")(
    lambda spark, sf: quantize.bounds(points(spark, sf)).select(F.posexplode(F.arrays_zip("lo", "hi")).alias("pos", "b")).select("pos", F.round("b.lo", 6).alias("lo"), F.round("b.hi", 6).alias("hi")))
query("scalar_quant", LOHI + "SELECT vec_id AS id, list(floor(greatest(0, least(1, (x - lo) / (hi - lo))) * 255)::INT ORDER BY pos) AS codes FROM x JOIN b USING (pos) GROUP BY 1")(
    lambda spark, sf: points(spark, sf).select("id", quantize.scalar_codes("vector", *spans(spark, sf)).alias("codes")))
query("scalar_quant_4bit", LOHI + ", c AS (SELECT vec_id, pos, floor(greatest(0, least(1, (x - lo) / (hi - lo))) * 15)::INT AS c FROM x JOIN b USING (pos)), p AS (SELECT vec_id, (pos - 1) // 2 AS k, sum(CASE WHEN pos % 2 = 1 THEN c * 16 ELSE c END)::INT AS n FROM c GROUP BY ALL) SELECT vec_id AS id, list(n ORDER BY k) AS codes FROM p GROUP BY 1")(
    lambda spark, sf: points(spark, sf).select("id", quantize.packed_nibbles(quantize.scalar_codes("vector", *spans(spark, sf), bits=4)).alias("codes")))
query("int8_quant", "SELECT vec_id AS id, list_transform(embedding, lambda x: greatest(-128, least(127, round((x::DOUBLE - 0.01) * 50)))::INT) AS codes FROM embeddings")(
    lambda spark, sf: points(spark, sf).select("id", quantize.int8_codes("vector", 50.0, 0.01).alias("codes")))


@query("binary_quant_hamming", """SELECT vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (embedding[i] > 0) <> (q[i] > 0) THEN 1 ELSE 0 END))::INT AS distance
  FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 0) ORDER BY distance, id LIMIT 20""")
def _(spark, sf):
    d = V.hamming(quantize.binary_codes("vector"), quantize.binary_codes(query_vector(spark, sf)))
    return points(spark, sf).select("id", d.alias("distance")).orderBy("distance", "id").limit(20)


def product(spark: SparkSession, sf: str) -> quantize.Product:
    return quantize.Product.train(quantize.sample(points(spark, sf), "vector"), parts=8, centres=16)


@query("pq_encode_adc")
def _(spark, sf):
    pq = product(spark, sf)
    codes = quantize.encoded(points(spark, sf), pq)
    return codes.select("id", F.round(quantize.code_distance(F.col("codes"), pq.table(np.array(query_vector(spark, sf)))), 4).alias("distance"))


@query("pq_rerank")
def _(spark, sf):
    pq = product(spark, sf)
    return quantize.reranked(points(spark, sf), quantize.encoded(points(spark, sf), pq), pq, query_vector(spark, sf))


@query("residual_quant_error")
def _(spark, sf):
    rq = quantize.Residual.train(quantize.sample(points(spark, sf), "vector"), 2, 16)
    return quantize.encoded(points(spark, sf), rq).agg(F.avg("error").alias("mean_error"))


@query("ivf_probe")
def _(spark, sf):
    lists = index.Lists.train(points(spark, sf), 16)
    return lists.search(lists.assigned(points(spark, sf)), query_vector(spark, sf), 10, 8)


query("lsh_buckets")(lambda spark, sf: index.hyperplanes(points(spark, sf), 64).groupBy("table").agg(F.countDistinct("bucket").alias("buckets")))


@query("learned_index", """WITH c AS (SELECT o_totalprice AS k, count(*) AS n FROM orders GROUP BY 1), r AS (SELECT k, coalesce(sum(n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS r, ntile(4) OVER (ORDER BY k) AS piece FROM c)
SELECT piece::INT AS piece, min(k) AS low, round(regr_slope(r, k), 6) AS slope, round(regr_intercept(r, k), 2) AS intercept FROM r GROUP BY 1""")  # fmt: skip
def _(spark, sf):
    return index.learned(table(spark, sf, "orders"), "o_totalprice").withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 2)})


# texts


def contains_sql(words: list[str], at_start: bool, column: str = "t") -> str:
    return " OR ".join(f"starts_with({column}, '{w}')" if at_start else f"contains({column}, '{w}')" for w in words)


INTENT_SQL = "CASE " + " ".join(f"WHEN {contains_sql(words, start)} THEN '{name}'" for name, words, start in text.INTENTS) + " WHEN ends_with(t, '?') THEN 'Factual' ELSE 'Unknown' END"
query("query_intent", f"SELECT conv_id, turn, {INTENT_SQL} AS intent FROM (SELECT conv_id, turn, lower(text) AS t FROM conversations)")(lambda spark, sf: table(spark, sf, "conversations").select("conv_id", "turn", text.intent(F.col("text")).alias("intent")))

_made = ", ".join(f"CASE WHEN contains(t, '{w}') THEN replace(t, '{w}', '{s}') END" for w, many in text.SYNONYMS.items() for s in many)
query("query_expansion", f"""WITH q AS (SELECT p_partkey, 'A ' || p_name || ' fast START' AS q, lower('A ' || p_name || ' fast START') AS t FROM part),
l AS (SELECT p_partkey, list_filter([q, {_made}], lambda x: x IS NOT NULL) AS l FROM q)
SELECT p_partkey, list_filter(l, lambda x, i: list_position(l, x) = i)[1:5] AS expansions FROM l""")(
    lambda spark, sf: table(spark, sf, "part").select("p_partkey", text.expansions(F.concat(F.lit("A "), "p_name", F.lit(" fast START"))).alias("expansions")))
query("word_variations", """SELECT p_partkey, list_filter([w, CASE WHEN ends_with(l, 'ing') THEN l[:-4] END, CASE WHEN ends_with(l, 'ed') THEN l[:-3] END, CASE WHEN ends_with(l, 's') AND length(l) > 1 THEN l[:-2] END, CASE WHEN ends_with(l, 'es') AND length(l) > 2 THEN l[:-3] END],
  lambda x: x IS NOT NULL) AS variations FROM (SELECT p_partkey, p_type || CASE p_partkey % 4 WHEN 0 THEN 'ing' WHEN 1 THEN 'ed' WHEN 2 THEN 'es' ELSE '' END AS w, lower(w) AS l FROM part)""")(
    lambda spark, sf: table(spark, sf, "part").select("p_partkey", text.variations(F.concat("p_type", F.element_at(F.array(F.lit("ing"), F.lit("ed"), F.lit("es"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int")))).alias("variations")))
query("document_entities", r"SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|\s)(\p{Lu}\S*(?:\s+\p{Lu}\S*)*)', 1)) AS entity FROM documents")(lambda spark, sf: table(spark, sf, "documents").select("doc_id", F.explode(text.document_entities(F.col("text"))).alias("entity")))
# each word between single spaces of its own, so that a run of words is a run of characters; a run does not begin with the first word
ENTITIES = r"""w AS (SELECT conv_id, turn, text, lower(text) AS t, list_filter(string_split_regex(regexp_replace(text, '[^\p{L}\p{N}\p{M}\s]', ' ', 'g'), '\s+'), lambda x: x <> '') AS words FROM conversations),
e AS (SELECT conv_id, turn, text, t, list_filter(list_transform(regexp_extract_all(array_to_string(list_transform(words[2:], lambda x: ' ' || x || ' '), ''), ' \p{Lu}+[^\p{Lu} ][^ ]* (?: (?:\p{Lu}[^ ]*|of|the|and) )*'),
  lambda x: replace(trim(x), '  ', ' ')), lambda x: strlen(x) > 2) AS found FROM w)"""
query("query_entities", f"WITH {ENTITIES} SELECT conv_id, turn, found AS entities FROM e")(lambda spark, sf: table(spark, sf, "conversations").select("conv_id", "turn", text.query_entities(F.col("text")).alias("entities")))
query("query_plans", f"""WITH {ENTITIES}, i AS (SELECT *, {INTENT_SQL} AS intent, ({contains_sql(text.MULTI_HOP, False)} OR len(found) > 2) AND len(found) >= 2 AS planned FROM e)
SELECT conv_id, turn, intent, CASE WHEN NOT planned THEN '' WHEN intent = 'Comparative' THEN found[1] || '|' || found[2] || '|Compare ' || found[1] || ' vs ' || found[2] ELSE array_to_string(found, '|') END AS steps,
  CASE WHEN NOT planned THEN 0 WHEN intent = 'Comparative' THEN 2 ELSE len(found) - 1 END::INT AS dependencies FROM i""")(lambda spark, sf: _plans(table(spark, sf, "conversations")))


def _plans(rows: DataFrame) -> DataFrame:
    """The plans, flat: their steps' queries and how many dependencies these have together."""
    told = rows.select("conv_id", "turn", text.analysis(F.col("text")).alias("a")).select("conv_id", "turn", "a.intent", "a.plan")
    count = F.aggregate(F.transform("plan", lambda s: F.size(s.dependencies)), F.lit(0), lambda x, y: x + y)
    return told.select("conv_id", "turn", "intent", F.coalesce(F.array_join(F.transform("plan", lambda s: s["query"]), "|"), F.lit("")).alias("steps"), F.coalesce(count, F.lit(0)).alias("dependencies"))


# graphs


def arcs(spark: SparkSession, sf: str) -> DataFrame:
    nations = table(spark, sf, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    customers = table(spark, sf, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"))
    return nations.union(customers)


ARCS = "arcs AS (SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer)"
query("relations", f"WITH {ARCS} SELECT src, dst FROM arcs WHERE src = 'n3' OR dst = 'n3'")(lambda spark, sf: graph.relations(arcs(spark, sf), "n3"))
_turn = "SELECT node, 0.15 / n + 0.85 * coalesce((SELECT sum(p.rank * s.share) FROM shares s JOIN {p} p ON p.node = s.src WHERE s.dst = nodes.node), 0) AS rank FROM nodes, size"
query("pagerank", f"""WITH {ARCS}, shares AS (SELECT src, dst, count(*) / sum(count(*)) OVER (PARTITION BY src) AS share FROM arcs GROUP BY src, dst), nodes AS (SELECT src AS node FROM arcs UNION SELECT dst FROM arcs),
size AS (SELECT count(*) AS n FROM nodes), p0 AS (SELECT node, 1.0 / n AS rank FROM nodes, size), """ + ", ".join(f"p{k} AS ({_turn.format(p=f'p{k - 1}')})" for k in range(1, 5)) + " SELECT node, round(rank::DOUBLE, 6) AS rank FROM p4")(
    lambda spark, sf: graph.page_rank(arcs(spark, sf), turns=4).select("node", F.round("rank", 6).alias("rank")))
query("node_distances", f"""WITH RECURSIVE {ARCS}, both_ways AS (SELECT src, dst FROM arcs UNION SELECT dst, src FROM arcs), w AS (SELECT 'c1' AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM w JOIN both_ways ON node = src WHERE depth < 4)
SELECT node, min(depth)::INT AS depth FROM w GROUP BY 1""")(lambda spark, sf: graph.distances(arcs(spark, sf), "c1", 4))  # fmt: skip


@query("shortest_path", f"WITH {ARCS} SELECT unnest([0, 1, 2])::INT AS step, unnest(['c1', (SELECT dst FROM arcs WHERE src = 'c1'), (SELECT a.dst FROM arcs a WHERE a.src = (SELECT dst FROM arcs WHERE src = 'c1'))]) AS node")
def _(spark, sf):
    edges = arcs(spark, sf)
    nation = edges.where("src = 'c1'").first()["dst"]
    path = graph.shortest_path(edges, "c1", edges.where(F.col("src") == nation).first()["dst"])
    return spark.createDataFrame(list(enumerate(path)), "step int, node string")


# records and formats


def people(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("balance"), F.col("c_acctbal").cast("string"))
    return table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.array(F.col("c_acctbal").cast("float"), F.col("c_nationkey").cast("float")).alias("vector"), meta.alias("metadata"), F.col("c_custkey").alias("position"))


@query("transforms", "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'B' ELSE c_mktsegment END AS sector, round(c_acctbal, 2) AS balance, 1 AS dim FROM customer WHERE length(c_mktsegment) >= 8")
def _(spark, sf):
    rows = people(spark, sf).where(records.field_test(F.col("metadata")["segment"], "min_length", 8))
    meta = records.mapped(records.renamed(F.col("metadata"), "segment", "sector"), "sector", {"BUILDING": "B"})
    return rows.withColumn("metadata", meta).select("id", F.col("metadata")["sector"].alias("sector"), F.round(records.converted(F.col("metadata")["balance"], "string_to_number"), 2).alias("balance"), F.size(records.reduced(F.col("vector"), 1)).alias("dim"))


@query("validation_report", """WITH r AS (SELECT c_custkey % 100 AS id, c_custkey AS position, c_custkey % 9 = 0 AS bad FROM customer), d AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY position) > 1 AS dup FROM r), c AS (
  SELECT count(*) AS total, count(*) FILTER (NOT bad AND NOT dup) AS valid, count(*) FILTER (bad) AS invalid, count(*) FILTER (dup) AS duplicates FROM d)
SELECT *, valid / total AS success_rate, invalid / total AS error_rate, duplicates / total AS duplicate_rate FROM c""")  # fmt: skip
def _(spark, sf):
    rows = people(spark, sf).withColumns({"id": (F.col("position") % 100).cast("string"), "vector": F.when(F.col("position") % 9 == 0, F.array(F.lit(float("nan")).cast("float"), F.lit(1.0).cast("float"))).otherwise(F.col("vector"))})
    rows = records.first_of_id(rows, "id", "position").withColumn("errors", records.errors(F.col("id"), F.col("vector"), F.col("metadata"), 2))
    return records.report(rows)


query("magnitude_warnings", "SELECT CASE WHEN s = 0 THEN 'zero' WHEN s < 1e-6 THEN 'tiny' WHEN s > 1000 THEN 'huge' END AS warning, count(*) AS n FROM (SELECT sqrt((c_acctbal::FLOAT)::DOUBLE ** 2 + c_nationkey ** 2) AS s FROM customer) GROUP BY 1")(
    lambda spark, sf: people(spark, sf).groupBy(records.warnings(F.col("vector")).alias("warning")).agg(F.count(F.lit(1)).alias("n")))
query("dedup_ids", "SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")(
    lambda spark, sf: records.first_of_id(table(spark, sf, "events"), "user_id", "event_id").where(~F.col("duplicate")).select("user_id", "event_id"))
query("schema_check", "SELECT event_id, ['missing n', 'unexpected k'] AS errors FROM events")(lambda spark, sf: events(spark, sf).select("event_id", records.schema_errors(F.col("payload"), {"n": "Number"}).alias("errors")))


@query("record_differences", "SELECT vec_id AS id, CASE WHEN vec_id % 10 = 0 THEN 'missing' ELSE 'different' END AS difference FROM embeddings WHERE vec_id % 10 = 0 OR vec_id % 10 = 5 UNION ALL SELECT -1, 'unexpected'")
def _(spark, sf):
    source = points(spark, sf).select("id", "label")
    target = source.where("id % 10 != 0").withColumn("label", F.when(F.col("id") % 10 == 5, -1).otherwise(F.col("label"))).union(spark.createDataFrame([(-1, 0)], "id long, label int"))
    return records.differences(source, target)


def round_trip(kind: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        rows = points(spark, sf).select(F.col("id").cast("string").alias("id"), "vector", F.to_json(F.struct("label")).alias("metadata"))
        path = f"{temporary(spark, 'records')}.{kind}"
        formats.WRITERS[kind](rows, path)
        back = formats.READERS[kind](spark, path)
        total = V.total(F.transform("vector", lambda x: x.cast("double")))
        return back.select("id", F.round(total, 4).alias("total"), F.try_variant_get(F.parse_json("metadata"), "$.label", "int").alias("label"))

    return run


for _kind in formats.READERS:
    query(f"roundtrip_{_kind}", "SELECT vec_id::VARCHAR AS id, round(list_sum(embedding::DOUBLE[]), 4) AS total, label FROM embeddings")(round_trip(_kind))

query("progress", "SELECT o_orderkey, round(o_orderkey / 7.5, 4)::DOUBLE AS rate, round(2.5 * o_orderkey / 1000, 4)::DOUBLE AS estimate FROM orders")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", F.round(records.progress(F.col("o_orderkey"), F.lit(10**6), F.lit(7.5))["rate"], 4).alias("rate"), F.round(records.estimated_seconds(F.col("o_orderkey"), "dual_write"), 4).alias("estimate")))
query("numeric_ids", "SELECT p_partkey FROM part")(lambda spark, sf: table(spark, sf, "part").select(records.numeric_id(F.col("p_partkey").cast("string")).alias("p_partkey")))
query("sequence_numbers", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS sequence FROM orders")(lambda spark, sf: collections.numbered(table(spark, sf, "orders"), "o_custkey", "o_orderkey").select("o_orderkey", "sequence"))
query("context_window", "SELECT doc_id, coalesce(lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id), -1) AS before, coalesce(lead(doc_id) OVER (PARTITION BY source ORDER BY doc_id), -1) AS after FROM documents")(
    lambda spark, sf: text.context(table(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", *(F.coalesce(F.get(c, F.lit(0)), F.lit(-1)).alias(c) for c in ("before", "after"))))

# more quantisers and checks


@query("additive_quant_error")
def _(spark, sf):
    aq = quantize.Additive.train(quantize.sample(points(spark, sf), "vector"), 2, 16)
    return quantize.encoded(points(spark, sf), aq).agg(F.avg("error").alias("mean_error"))


@query("stacked_quant_error")
def _(spark, sf):
    sq = quantize.Stacked.train(quantize.sample(points(spark, sf), "vector"), 2, 8, 16)
    return quantize.encoded(points(spark, sf), sq).agg(F.avg("error").alias("mean_error"))


@query("serializability_cycles", "SELECT 'a' AS src, 'b' AS dst UNION ALL SELECT 'b', 'c' UNION ALL SELECT 'c', 'a'")
def _(spark, sf):
    more = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    return graph.on_cycles(arcs(spark, sf).union(more))


query("cardinality_guard", "SELECT event_type FROM events GROUP BY 1 HAVING count(DISTINCT user_id) > 20")(lambda spark, sf: history.too_many(table(spark, sf, "events"), "event_type", "user_id", 20).select("event_type"))


@query("cross_metric_distance", f"SELECT vec_id AS id, round(list_inner_product({D}, {Q0}), 4) AS dot, round(1 - list_cosine_similarity({D}, {Q0}), 4) AS cosine FROM embeddings e")
def _(spark, sf):
    q = query_vector(spark, sf)
    return points(spark, sf).select("id", F.round(V.calculate("ip", "vector", q), 4).alias("dot"), F.round(V.calculate("cosine", "vector", q), 4).alias("cosine"))

# small operators of the surrounding work

query("promoted_key", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 7")(
    lambda spark, sf: collections.promoted(events(spark, sf), "k", "integer").where("k > 7").select("event_id", "k"))


@query("vector_extraction", "SELECT vec_id AS id, round(list_sum(embedding::DOUBLE[]), 3) AS total FROM embeddings")
def _(spark, sf):
    named = F.when(F.col("id") % 2 == 0, F.to_json(F.struct(F.col("vector").alias("embedding")))).otherwise(F.to_json(F.struct(F.col("vector").alias("vec"))))
    found = records.vector_of(F.parse_json(named))
    return points(spark, sf).select("id", F.round(V.total(F.transform(found, lambda x: x.cast("double"))), 3).alias("total"))


query("durations", """SELECT o_orderkey, CASE WHEN h > 0 THEN h || 'h ' || m || 'm ' || s || 's' WHEN m > 0 THEN m || 'm ' || s || 's' ELSE s || 's' END AS duration
FROM (SELECT o_orderkey, o_orderkey // 3600 AS h, o_orderkey % 3600 // 60 AS m, o_orderkey % 60 AS s FROM orders)""")(
    lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", records.duration(F.col("o_orderkey")).alias("duration")))
query("fault_tolerance", "SELECT p_partkey, round(greatest(0, (50 - p_size) / 50 - p_size / 50), 6)::DOUBLE AS score FROM part")(
    lambda spark, sf: table(spark, sf, "part").select("p_partkey", F.round(history.fault_tolerance(F.lit(50), F.col("p_size")), 6).alias("score")))
query("record_batch", "SELECT p_partkey AS id, p_name FROM part ORDER BY 1 LIMIT 20 OFFSET 30")(lambda spark, sf: formats.fetched(table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name"), 30, 20))
query("score_with_payload", nearest_sql("dot", limit=6).replace("round(score, 4) AS score", "round(score, 4) AS score, (SELECT label FROM embeddings x WHERE x.vec_id = s.id) AS label"))(
    lambda spark, sf: search.search(with_payload(spark, sf), search.Request(query_vector(spark, sf), 6, metric="IP", with_payload=["label"])).select("rank", "id", F.round("score", 4).alias("score"), F.try_variant_get("payload", "$.label", "int").alias("label")))
query("range_scan", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id BETWEEN 10 AND 40")(lambda spark, sf: collections.scanned(points(spark, sf), 10, 40).select("id", "label"))
query("group_consecutive_writes", "SELECT user_id, sum(CASE WHEN event_type = before THEN 1 ELSE 0 END)::BIGINT AS repeats FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) GROUP BY 1")(
    lambda spark, sf: history.repeats(table(spark, sf, "events"), "user_id", "event_id", "event_type"))

from sagitta import queries_more  # noqa: E402, F401
