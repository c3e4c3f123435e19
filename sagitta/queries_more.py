"""More queries: batches by every metric, filters by path, collections' housekeeping, records, streams and indexes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagitta.functions import records
from sagitta.functions import vectors as V
from sagitta.operators import cache, collections, filters, history, index, quantize, replication, search, workloads
from sagitta.plans import dialects
from sagitta.queries import D, Q0, batch_sql, events, nearest_sql, operations, points, product, query, query_vector, table, with_payload
from sagitta.sources import backup, checkpoints, formats
from sagitta.sources.files import temporary
from sagitta.streaming import changes

# batches by every metric, with filters and thresholds

L1 = "list_sum(list_transform(range(1, 65), lambda i: abs(e.embedding[i]::DOUBLE - q.embedding[i]::DOUBLE)))"


def batch_of(value: str, order: str, where: str = "true") -> str:
    return batch_sql(5, where).replace("list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])", value).replace("ORDER BY score DESC", f"ORDER BY score {order}")


def batched(spark: SparkSession, sf: str, limit: int = 5, **options) -> DataFrame:
    queries = points(spark, sf).where(F.col("id") % 100 == 0).select(F.col("id").alias("query_id"), "vector")
    return search.search_batch(with_payload(spark, sf), queries, limit, **options).select("query_id", "rank", "id", F.round("score", 4).alias("score"))


query("knn_batch_dot", batch_of("list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])", "DESC"))(lambda spark, sf: batched(spark, sf, metric="dot"))
query("knn_batch_l2", batch_of("list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[])", "ASC"))(lambda spark, sf: batched(spark, sf, metric="l2"))
query("knn_batch_l1", batch_of(L1, "ASC"))(lambda spark, sf: batched(spark, sf, metric="l1"))
query("knn_batch_filtered", batch_of("list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])", "DESC", "e.label IN (1, 2, 3) AND list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) >= 0.1"))(
    lambda spark, sf: batched(spark, sf, condition=filters.MatchAny("label", [1, 2, 3]), threshold=0.1))


@query("search_with_vector", nearest_sql("cosine", limit=3).replace("round(score, 4) AS score", "round(score, 4) AS score, (SELECT len(embedding)::INT FROM embeddings x WHERE x.vec_id = s.id) AS dim"))
def _(spark, sf):
    found = search.search(with_payload(spark, sf), search.Request(query_vector(spark, sf), 3, with_vector=True))
    return found.select("rank", "id", F.round("score", 4).alias("score"), F.size("vector").alias("dim"))


@query("explore_far", f"""WITH s AS (SELECT 'c' || (label % 2) AS collection, vec_id AS id, list_cosine_similarity({D}, {Q0}) AS score FROM embeddings e)
SELECT row_number() OVER (ORDER BY score DESC, collection, id)::INT AS rank, collection, id, round(score, 4) AS score FROM s QUALIFY rank > 60 AND rank <= 70""")  # fmt: skip
def _(spark, sf):
    rows = points(spark, sf)
    return search.explore({f"c{k}": rows.where(F.col("label") % 2 == k) for k in (0, 1)}, search.Request(query_vector(spark, sf), 10, 60)).select("rank", "collection", "id", F.round("score", 4).alias("score"))


@query("vector_arithmetic", f"""SELECT vec_id AS id, round(list_sum(list_transform(range(1, 65), lambda i: embedding[i]::DOUBLE - q[i])), 3) AS difference, round(1.5 * list_sum({D}), 3) AS scaled, 64.0 AS ones, true AS bounded
FROM embeddings e, (SELECT {Q0} AS q)""")
def _(spark, sf):
    q = query_vector(spark, sf)
    noise = V.random(8, 5)
    return points(spark, sf).select(
        "id", F.round(V.total(V.subtract("vector", q)), 3).alias("difference"), F.round(V.total(V.scale("vector", 1.5)), 3).alias("scaled"), V.total(V.ones(64)).alias("ones"),
        F.forall(noise, lambda x: (x >= -1) & (x < 1)).alias("bounded"))


# filters by path

ORDERS = "SELECT o_orderkey AS id FROM orders WHERE "


def nested(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with a nested payload: status, an object, an array of objects, an array of numbers, a null and a field that some lack."""
    k = F.col("o_orderkey")
    items = F.array(F.struct((k % 5).alias("n"), F.concat(F.lit("tag "), (k % 3).cast("string")).alias("name")), F.struct((k % 7).alias("n"), F.lit("Common").alias("name")))
    body = F.struct(
        F.col("o_orderstatus").alias("status"), F.struct(F.col("o_orderpriority").alias("level"), F.struct((k % 11).alias("n")).alias("deep")).alias("info"), items.alias("items"),
        F.when(k % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k % 6, k % 10)).alias("codes"), F.when(k % 2 == 0, k).alias("maybe"))
    return table(spark, sf, "orders").select(k.alias("id"), F.parse_json(F.to_json(body)).alias("payload"))


def filtered(name: str, condition: filters.Condition, where: str) -> None:
    query(name, ORDERS + where)(lambda spark, sf: filters.where(nested(spark, sf), condition).select("id"))


filtered("filter_dotted_key", filters.Filter(must=[filters.Match("info.level", "1-URGENT"), filters.Range("info.deep.n", gte=4)]), "o_orderpriority = '1-URGENT' AND o_orderkey % 11 >= 4")
filtered("filter_array_elements", filters.Filter(must=[filters.Match("items[].n", 6), filters.MatchText("items[].name", "TAG 1")]), "(o_orderkey % 5 = 6 OR o_orderkey % 7 = 6) AND o_orderkey % 3 = 1")
filtered("filter_match_array", filters.Match("codes", 5), "o_orderkey % 4 <> 0 AND (o_orderkey % 6 = 5 OR o_orderkey % 10 = 5)")
filtered("filter_text", filters.MatchText("info.level", "URG"), "contains(lower(o_orderpriority), 'urg')")
filtered("filter_exists", filters.Filter(must=[filters.Exists("maybe")], must_not=[filters.Exists("absent")]), "o_orderkey % 2 = 0")
filtered("filter_empty", filters.IsEmpty("codes"), "o_orderkey % 4 = 0")
filtered("filter_has_id", filters.Filter(must=[filters.HasId([1, 2, 3, 7, 32, 99999999])], must_not=[filters.Match("status", "F")]), "o_orderkey IN (1, 2, 3, 7, 32, 99999999) AND o_orderstatus <> 'F'")


@query("filter_null", "SELECT c_custkey AS id, c_custkey % 3 = 0 AS missing, c_custkey % 3 = 1 AS is_null FROM customer")
def _(spark, sf):
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("id"), F.parse_json(F.when(k % 3 == 0, "{}").when(k % 3 == 1, '{"x": null}').otherwise('{"x": 1}')).alias("payload"))
    return rows.select("id", (~filters.Exists("x").column(F.col("payload"))).alias("missing"), filters.IsNull("x").column(F.col("payload")).alias("is_null"))


query("filter_fields", "SELECT unnest(['items', 'info', 'status']) AS field")(
    lambda spark, sf: spark.createDataFrame([(x,) for x in sorted(filters.Filter(must=[filters.Match("info.level", "x")], should=[filters.Filter(must_not=[filters.Match("items[].n", 1)])], must_not=[filters.IsNull("status")]).fields())], "field string"))
query("many_ids", "SELECT o_orderkey AS id FROM orders WHERE o_custkey % 10 = 1")(
    lambda spark, sf: filters.by_ids(table(spark, sf, "orders").withColumnRenamed("o_orderkey", "id"), table(spark, sf, "orders").where("o_custkey % 10 = 1").select(F.col("o_orderkey").alias("id"))).select("id"))
query("payload_exclude", "SELECT o_orderkey AS id, ['codes', 'info', 'status'] || CASE WHEN o_orderkey % 2 = 0 THEN ['maybe'] ELSE [] END AS keys FROM orders")(
    lambda spark, sf: nested(spark, sf).select("id", filters.projected(F.col("payload"), exclude=["items"]).alias("p")).select("id", F.concat(F.array_sort(F.filter(_keys("p"), lambda x: x != "maybe")), F.filter(_keys("p"), lambda x: x == "maybe")).alias("keys")))


def _keys(column: str):
    return F.map_keys(F.try_variant_get(column, "$", "map<string,variant>"))


@query("aggregate_count", "SELECT label::VARCHAR AS label, count(*) AS count FROM embeddings GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM embeddings")
def _(spark, sf):
    by = dialects.graph_query('{ Aggregate { Point(groupBy: ["label"]) { meta { count } } } }').aggregate(with_payload(spark, sf))
    return by.unionByName(dialects.graph_query("{ Aggregate { Point { meta { count } } } }").aggregate(with_payload(spark, sf)).withColumn("label", F.lit(None).cast("string")))


# collections


def filled(spark: SparkSession, sf: str) -> tuple[collections.Catalog, collections.Collection]:
    catalog = collections.Catalog(spark, temporary(spark, "catalog"))
    c = catalog.create("points", 64, "l2")
    c.upsert(points(spark, sf).select("id", "vector", F.to_json(F.struct("label")).alias("payload")))
    return catalog, c


@query("incremental_snapshots", "SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN -1 ELSE label END AS label FROM embeddings WHERE vec_id % 3 <> 0 OR vec_id % 2 = 0")
def _(spark, sf):
    _, c = filled(spark, sf)
    full = c.snapshot("full")
    c.delete([r.id for r in points(spark, sf).where("id % 3 = 0 and id % 2 != 0").select("id").toLocalIterator()])
    c.upsert(points(spark, sf).where("id % 2 = 0").select("id", "vector", F.lit('{"label":-1}').alias("payload")))
    part = c.snapshot("part", since=full)
    c.restore(full)
    c.restore(part)
    return c.points().select("id", F.try_variant_get("payload", "$.label", "int").alias("label"))


@query("many_runs", "SELECT vec_id AS id, CASE WHEN vec_id % 12 = 11 THEN -1 ELSE vec_id % 12 END AS turn FROM embeddings WHERE vec_id % 12 <> 5")
def _(spark, sf):
    """A dozen changes of a twelfth each: runs are merged on the way, and compacted at last."""
    _, c = filled(spark, sf)
    for turn in range(12):
        mine = points(spark, sf).where(F.col("id") % 12 == turn)
        c.upsert(mine.select("id", "vector", F.lit(f'{{"turn":{turn if turn < 11 else -1}}}').alias("payload")))
    c.delete(condition=filters.Match("turn", 5))
    c.compact()
    return c.points().select("id", F.try_variant_get("payload", "$.turn", "bigint").alias("turn"))


@query("appended_ids", "SELECT (SELECT max(vec_id) FROM embeddings) + row_number() OVER (ORDER BY vec_id) AS id FROM embeddings WHERE vec_id % 10 = 0")
def _(spark, sf):
    _, c = filled(spark, sf)
    top = c.points().agg(F.max("id")).first()[0]
    c.append(points(spark, sf).where("id % 10 = 0").select("vector"))
    return c.points().where(F.col("id") > top).select("id")


@query("catalog_entries", "SELECT unnest(['other', 'points']) AS name, unnest([2, 64]) AS dim, unnest([0, (SELECT count(*) FROM embeddings)]) AS points, unnest(['x', NULL]) AS note")
def _(spark, sf):
    catalog, _ = filled(spark, sf)
    catalog.create("other", 2)
    catalog.create("gone", 3)
    catalog.drop("gone")
    catalog.update("other", note="x")
    told = [catalog.describe(n) for n in catalog.list()]
    return spark.createDataFrame([(t["name"], t["dim"], t["points"], t.get("note")) for t in told], "name string, dim int, points long, note string")


@query("get_point", "SELECT vec_id AS id, label FROM embeddings WHERE vec_id = 7")
def _(spark, sf):
    return filled(spark, sf)[1].get(7).select("id", F.try_variant_get("payload", "$.label", "int").alias("label"))


@query("find_object", "SELECT unnest(['copy', 'points']) AS collection, 5 AS id")
def _(spark, sf):
    catalog, c = filled(spark, sf)
    catalog.create("copy", 64).upsert(c.points().where("id < 9").select("id", "vector", F.to_json("payload").alias("payload")))
    catalog.create("none", 64)
    return catalog.find(5).select("collection", F.col("id").cast("int").alias("id"))


@query("backup_restore", "SELECT vec_id AS id FROM embeddings")
def _(spark, sf):
    catalog, c = filled(spark, sf)
    store = temporary(spark, "backups")
    name = backup.create(spark, catalog.path, store)
    c.delete(condition=filters.Range("label", gte=0))
    assert c.count() == 0
    backup.restore(spark, store, name, catalog.path)
    return catalog.open("points").points().select("id")


@query("checkpoint_stats", "SELECT 2 AS jobs, 15 AS processed, 1 AS failed, 10 AS resumed")
def _(spark, sf):
    kept = checkpoints.Checkpoints(spark, temporary(spark, "checkpoints"))
    kept.save("a", 4, 4)
    kept.save("a", 10, 10)
    kept.save("b", 5, 5, 1)
    told = kept.statistics()
    return spark.createDataFrame([(told["jobs"], told["processed"], told["failed"], kept.load("a")["offset"])], "jobs int, processed int, failed int, resumed int")


@query("result_cache", "SELECT 1 AS hits, 2 AS misses, (SELECT count(*) FROM embeddings WHERE label = 3) AS count")
def _(spark, sf):
    kept = cache.Results()
    make = lambda: search.count(with_payload(spark, sf), filters.Match("label", 3))
    n = [kept.get("three", make, version).first()[0] for version in (1, 1, 2)][-1]
    told = kept.statistics()
    kept.clear()
    return spark.createDataFrame([(told["hits"], told["misses"], n)], "hits int, misses int, count long")


# histories, replication and streams


@query("rate_window_samples", """WITH r AS (SELECT event_id, user_id, epoch_us(ts) AS a, value AS v, min(struct_pack(a := epoch_us(ts), v := value)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS f,
  min(struct_pack(a := epoch_us(ts), v := value)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), value ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS g FROM events), s AS (SELECT *, greatest(f, g) AS h FROM r)
SELECT event_id, round(CASE WHEN a - h.a > 0 THEN (v - h.v) / ((a - h.a) / 1e6::DOUBLE) ELSE 0 END, 6) AS rate FROM s""")
def _(spark, sf):
    return history.window_rate(table(spark, sf, "events"), "ts", "value", "user_id", 86400, 3).select("event_id", F.round("rate", 6).alias("rate"))


@query("register_replay")
def _(spark, sf):
    """Not in SQL: what a compare-and-set leaves depends on all operations before it. Tested against a plain replay."""
    kind = F.when(F.col("event_type") == "purchase", "write").when(F.col("event_type") == "signup", "cas").when(F.col("event_type") == "error", "other").otherwise("read")
    rows = table(spark, sf, "events").select("event_id", (F.col("user_id") % 20).alias("key"), kind.alias("kind"), (F.floor("value") % 3).alias("v"), (F.col("event_id") % 3).alias("old"), (F.col("event_id") % 5 != 0).alias("ok"))
    return history.replayed(rows, "key", ["event_id"], "kind", "v", "old", "ok").select("event_id", "expected")


query("custom_resolver", "SELECT user_id % 50 AS key, arg_max(event_id, (event_id % 7, event_id)) AS op_id FROM events GROUP BY 1")(
    lambda spark, sf: replication.custom(operations(spark, sf).select("op_id", "key"), lambda p: p.assign(rest=p.op_id % 7).sort_values(["rest", "op_id"]).tail(1)[["op_id", "key"]]))
query("conflict_members", "SELECT event_id AS op_id, user_id % 50 AS key, min(event_id) OVER (PARTITION BY user_id % 50, event_id % 7, event_id // 7 % 5) AS first FROM events WHERE event_type <> 'signup'")(
    lambda spark, sf: replication.clock_classes(operations(spark, sf)).withColumn("first", F.min("op_id").over(Window.partitionBy("key", "_clock"))).select("op_id", "key", "first"))


@query("cdc_published", "SELECT vec_id AS vector_id FROM embeddings WHERE vec_id % 4 <> 0")
def _(spark, sf):
    """Two batches through the log: what the stream of them leaves as state."""
    log, out, mark = (temporary(spark, n) for n in ("log", "state", "mark"))
    before = points(spark, sf).select("id", "vector")
    first = changes.difference(before.limit(0), before, "c")
    for batch in (first, changes.difference(before, before.where("id % 4 != 0"), "c", start=first.count())):
        changes.append(batch, log)
        changes.materialise(changes.subscribe(spark, log, "c"), out, mark).awaitTermination()
    return spark.read.parquet(f"{out}/v1").where("not deleted").select("vector_id")


query("log_gaps", "SELECT unnest(['a', 'b']) AS collection, unnest([3, 1]) AS sequence, unnest([1, NULL]) AS before")(
    lambda spark, sf: changes.gaps(spark.createDataFrame([("a", 0), ("a", 1), ("a", 3), ("a", 4), ("b", 1), ("c", 0)], "collection string, sequence long")).select("collection", F.col("sequence").cast("int").alias("sequence"), F.col("before").cast("int").alias("before")))


@query("loaded_states", "SELECT unnest(['not loaded', 'loaded', 'stale', 'not loaded']) AS state, unnest([0, 1, 2, 3]) AS step")
def _(spark, sf):
    catalog, c = filled(spark, sf)
    told = [catalog.load_state("points")]
    catalog.load("points")
    told.append(catalog.load_state("points"))
    c.delete([1])
    told.append(catalog.load_state("points"))
    catalog.release("points")
    told.append(catalog.load_state("points"))
    return spark.createDataFrame(list(zip(told, range(4), strict=True)), "state string, step int")


def drawn(what: str, step: str = "0", times: int = 1) -> str:
    return f"(CAST('0x' || substr(md5('0:{what}:' || id || ':' || {step}), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE)" + (f" * {times}" if times > 1 else "")


@query("bank_balances", f"""WITH t AS (SELECT id, floor({drawn("key", times=10)})::BIGINT AS a, floor({drawn("to", times=9)})::BIGINT AS d, 1 + floor({drawn("value", times=100)})::BIGINT AS v FROM range(5000) r(id) WHERE {drawn("kind")} >= 0.3),
m AS (SELECT a AS k, -v AS v FROM t UNION ALL SELECT (a + 1 + d) % 10, v FROM t) SELECT 'account-' || k AS key, sum(v) + 1000 AS balance FROM m GROUP BY 1""")
def _(spark, sf):
    return workloads.balances(workloads.history(spark, "bank", 5000), 1000)


_others = " UNION ALL ".join(
    f"""SELECT '{kind}' AS work, CASE WHEN {drawn("kind", "step")} < {w.reads}::DOUBLE THEN 'read' ELSE '{w.does}' END AS kind, count(*) AS n, count(DISTINCT floor({drawn("key", "step", w.count)})) AS objects
FROM (SELECT id, unnest(range(0, 1 + floor((CAST('0x' || substr(md5('0:size:' || id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE) * {w.size})::BIGINT)) AS step FROM range(500) r(id)) GROUP BY ALL"""
    for kind, w in workloads.KINDS.items()
)


@query("workload_kinds", _others)
def _(spark, sf):
    out = None
    for kind in workloads.KINDS:
        told = workloads.history(spark, kind, 500).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("key").alias("objects")).withColumn("work", F.lit(kind))
        out = told if out is None else out.unionByName(told)
    return out


# quantisers and indexes

query("delta_lists", "SELECT label, list_sort(list(vec_id)) AS ids, list_sort(list(vec_id))[1] AS first FROM embeddings GROUP BY 1")(
    lambda spark, sf: points(spark, sf).groupBy("label").agg(quantize.deltas(F.sort_array(F.collect_list("id"))).alias("steps")).select("label", quantize.from_deltas(F.col("steps")).alias("ids"), F.col("steps")[0].alias("first")))


@query("ivf_exact", nearest_sql("l2"))
def _(spark, sf):
    """All lists probed: the exact result."""
    lists = index.Lists.train(points(spark, sf), 16)
    found = lists.search(lists.assigned(points(spark, sf)), query_vector(spark, sf), 10, 16)
    return found.withColumn("rank", F.row_number().over(Window.orderBy("score", "id"))).select("rank", "id", F.round("score", 4).alias("score"))


@query("ivf_recall", "SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def _(spark, sf):
    """Recall of twelve of sixteen lists against brute force, over every query: 0.9 at least."""
    rows = points(spark, sf)
    queries = rows.where("id % 100 = 0").select(F.col("id").alias("query_id"), "vector")
    return index.recall(rows, queries, index.Lists.train(rows, 16), 10, 12).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("pq_rerank_all", nearest_sql("l2").replace("round(score, 4) AS score", "round(score, 4) AS distance"))
def _(spark, sf):
    """Every point re-ranked after the codes: the exact result."""
    pq = product(spark, sf)
    rows = points(spark, sf)
    found = quantize.reranked(rows, quantize.encoded(rows, pq), pq, query_vector(spark, sf), 10, max(1.0, rows.count() / 10))
    return found.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id"))).select("rank", "id", F.round("distance", 4).alias("distance"))


@query("quantiser_gains", "SELECT unnest(['additive', 'product', 'residual', 'stacked']) AS quantiser, (SELECT count(*) FROM embeddings) AS vectors, true AS better")
def _(spark, sf):
    """Every quantiser's mean error is under that of the mean vector."""
    rows, x = points(spark, sf), quantize.sample(points(spark, sf), "vector")
    spread = float(np.square(x - x.mean(0)).sum(1).mean())
    made = {"product": quantize.Product.train(x, 8, 16), "residual": quantize.Residual.train(x, 2, 16), "additive": quantize.Additive.train(x, 2, 16), "stacked": quantize.Stacked.train(x, 2, 8, 16)}
    out = None
    for name, q in made.items():
        told = quantize.encoded(rows, q).agg(F.count(F.lit(1)).alias("vectors"), (F.avg("error") < spread).alias("better")).select(F.lit(name).alias("quantiser"), "vectors", "better")
        out = told if out is None else out.unionByName(told)
    return out


@query("ivf_pq_all", nearest_sql("l2").replace("round(score, 4) AS score", "round(score, 4) AS distance"))
def _(spark, sf):
    """Lists and product codes, with all lists probed and every row re-ranked: the exact result."""
    rows, pq = points(spark, sf), product(spark, sf)
    lists = index.Lists.train(rows, 16)
    found = lists.search_codes(lists.assigned(rows), quantize.encoded(rows, pq), pq, query_vector(spark, sf), 10, 16, max(1.0, rows.count() / 10))
    return found.withColumn("rank", F.row_number().over(Window.orderBy("distance", "id"))).select("rank", "id", F.round("distance", 4).alias("distance"))


@query("bucket_search", "SELECT vec_id AS id, 0.0 AS score FROM embeddings WHERE vec_id = 0")
def _(spark, sf):
    """The query's own vector is in all of its buckets, so it comes first."""
    return index.bucket_search(points(spark, sf), query_vector(spark, sf), 10).orderBy("score", "id").limit(1).select("id", F.round("score", 4).alias("score"))


query("index_advice", "SELECT unnest([100, 100000, 10000000]) AS points, unnest(['flat', 'lists', 'lists, high recall']) AS advice")(
    lambda spark, sf: spark.createDataFrame([(n, index.advice(n, 64)) for n in (100, 100_000, 10_000_000)], "points int, advice string"))

# records

query("json_sizes", "SELECT o_orderkey AS id, strlen('{\"k\":' || o_orderkey || ',\"s\":\"' || o_orderstatus || '\"}')::INT AS bytes FROM orders")(
    lambda spark, sf: table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), records.json_size(F.parse_json(F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))))).alias("bytes")))


@query("nested_validation", "SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 1 THEN ['bad key'] WHEN 2 THEN ['long array'] WHEN 3 THEN ['long text'] WHEN 4 THEN ['no object'] ELSE [] END AS errors FROM customer")
def _(spark, sf):
    k = F.col("c_custkey") % 5
    many, long = F.to_json(F.named_struct(F.lit("a"), F.sequence(F.lit(1), F.lit(1001)))), F.concat(F.lit('{"t":"'), F.repeat(F.lit("x"), 10_001), F.lit('"}'))
    body = F.when(k == 1, '{"in":{"1x":2}}').when(k == 2, many).when(k == 3, long).when(k == 4, "[1]").otherwise('{"a":[1,2],"b":{"c":1}}')
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), records.metadata_errors(F.parse_json(body)).alias("errors"))


@query("text_ids", "SELECT count(*) AS ids, count(*) AS different, count(*) FILTER (p_partkey % 2 = 0) AS same FROM part")
def _(spark, sf):
    """Ids that are numbers are themselves, others get a hash of their own."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey").cast("string")).otherwise(F.concat(F.lit("part-"), "p_partkey"))
    rows = table(spark, sf, "part").select("p_partkey", records.numeric_id(name).alias("n"))
    return rows.agg(F.count(F.lit(1)).alias("ids"), F.count_distinct("n").alias("different"), F.count_if(F.col("n") == F.col("p_partkey")).alias("same"))


query("field_tests", "SELECT c_custkey AS id, true AS there, length(c_name) <= 18 AS short, regexp_matches(c_name, '[13579]$') AS odd FROM customer")(
    lambda spark, sf: table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), records.field_test(F.col("c_name"), "exists").alias("there"), records.field_test(F.col("c_name"), "max_length", 18).alias("short"), records.field_test(F.col("c_name"), "regex", "[13579]$").alias("odd")))


@query("format_conversion", "SELECT vec_id::VARCHAR AS id, len(embedding)::INT AS dim, (SELECT count(*) FROM embeddings) AS records FROM embeddings")
def _(spark, sf):
    rows = points(spark, sf).select(F.col("id").cast("string").alias("id"), "vector", F.to_json(F.struct("label")).alias("metadata"))
    a, b = f"{temporary(spark, 'from')}.jsonl", f"{temporary(spark, 'to')}.parquet"
    formats.write_jsonl(rows, a)
    n = formats.convert(spark, a, b)
    assert formats.format_of(b) == "parquet" and formats.parquet_info(spark, b).agg(F.sum("rows")).first()[0] == n
    return formats.read_parquet(spark, b).select("id", F.size("vector").alias("dim"), F.lit(n).cast("long").alias("records"))


query("event_payload_types", "SELECT event_id, 'Number' AS kind FROM events")(lambda spark, sf: events(spark, sf).select("event_id", records.json_type(F.try_variant_get("payload", "$.k", "variant")).alias("kind")))

