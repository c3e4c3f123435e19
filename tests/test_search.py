import numpy as np
import pytest
from pyspark.sql import functions as F

from sagitta.functions import udfs
from sagitta.functions import vectors as V
from sagitta.operators import filters as f
from sagitta.operators import index, quantize, search
from sagitta.operators.collections import Catalog
from sagitta.plans import dialects


def points(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>, json string").withColumn("payload", F.parse_json("json")).drop("json")


@pytest.fixture(scope="module")
def three(spark):
    return points(spark, [(1, [2.0, 1.0, -0.5, 5.0], '{"glaze":"ash"}'), (2, [4.0, 1.5, 0.25, 6.0], '{"glaze":"salt"}'), (3, [-3.0, 7.0, 1.0, 0.5], None)])


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_metrics(spark):
    a, b = [1.0, 2.0, 3.0], [4.0, 6.0, 3.0]
    assert one(spark, V.euclidean(a, b)) == 5
    assert one(spark, V.manhattan(a, b)) == 7
    assert one(spark, V.dot(a, b)) == 25
    assert one(spark, V.cosine_similarity(a, [0.0, 0.0, 0.0])) == 0
    assert one(spark, V.cosine_distance(a, [0.0, 0.0, 0.0])) == 1
    assert one(spark, V.dot(a, [1.0])) is None
    assert one(spark, V.normalize([0.0, 0.0])) == [0, 0]
    assert one(spark, V.normalize([3.0, 4.0])) == pytest.approx([0.6, 0.8])
    assert V.metric("IP") is V.DOT and V.metric("whatever") is V.COSINE
    with pytest.raises(Exception, match="unequal length"):
        one(spark, V.calculate("l2", a, [1.0]))


def test_search_order_and_score(three):
    got = search.search(three, search.Request([2.0, 1.0, -0.5, 5.0], with_payload=True, with_vector=True)).collect()
    assert got[0].id == 1 and got[0].score == pytest.approx(1) and got[0].distance == pytest.approx(0) and [r.rank for r in got] == [1, 2, 3]
    assert [r.id for r in search.search(three, search.Request([2.0, 1.0, -0.5, 5.0], limit=1, offset=1)).collect()] == [2]
    for bad in ([], [float("nan")]):
        with pytest.raises(ValueError):
            search.search(three, search.Request(bad))
    with pytest.raises(ValueError):
        search.Request([1.0], limit=0).check()


def test_batch_equals_single(spark, three):
    queries = three.select(F.col("id").alias("query_id"), "vector")
    for m in ("cosine", "dot", "l2", "l1"):
        got = {(r.query_id, r["rank"]): r.id for r in search.search_batch(three, queries, 2, m).collect()}
        for r in queries.collect():
            single = search.search(three, search.Request(list(r.vector), 2, metric=m)).collect()
            assert [got[r.query_id, k] for k in (1, 2)] == [s.id for s in single]


def test_explore_reaches_far_pages(spark):
    """An offset beyond the largest limit of a single search."""
    rows = spark.range(12_000).select("id", F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("vector"), F.lit(None).cast("variant").alias("payload"))
    got = search.explore({"a": rows}, search.Request([1.0, 0.0], 5, 11_000, "dot")).collect()
    assert [r.id for r in got] == [999, 998, 997, 996, 995] and got[0]["rank"] == 11_001


def test_batch_with_condition_and_threshold(spark, three):
    queries = three.select(F.col("id").alias("query_id"), "vector")
    got = search.search_batch(three, queries, 3, condition=f.Match("glaze", "ash")).collect()
    assert {(r.query_id, r.id) for r in got} == {(1, 1), (2, 1), (3, 1)}
    near = search.search_batch(three, queries, 3, "l2", threshold=3.0).collect()
    assert {(r.query_id, r.id) for r in near} == {(1, 1), (2, 2), (3, 3), (1, 2), (2, 1)}


def test_batch_ties_prefer_small_ids(spark):
    rows = points(spark, [(i, [1.0, 0.0], None) for i in range(100)])
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [r.id for r in search.search_batch(rows, q, 3).orderBy("rank").collect()] == [0, 1, 2]
    assert search.search_batch(rows, q.limit(0), 3).count() == 0
    assert search.search_batch(rows.limit(0), q, 3).count() == 0


PAYLOADS = [
    (1, '{"kiln":"Northgate","price":48.5,"clay":{"body":"stoneware","cone":"6a"},"tags":["a","b"],"n":3,"list":[{"x":1},{"x":2}],"none":null,"empty":[]}'),
    (2, '{"kiln":"Quayside","price":"48.5","n":"3"}'),
    (5, None),
]
CASES = [
    (f.Match("kiln", "Northgate"), {1}),
    (f.Match("clay.body", "stoneware"), {1}),
    (f.Range("price", gte=40, lte=60), {1}),
    (f.Range("price"), {1}),
    (f.Filter(must_not=[f.Match("glaze", "salt")]), {1, 2, 5}),
    (f.HasId([1, 2, 3]), {1, 2}),
    (f.Match("tags", "b"), {1}),
    (f.Match("n", 3), {1}),
    (f.Match("n", "3"), {2}),
    (f.MatchInteger("tags", 1), set()),
    (f.MatchText("kiln", "THGA"), {1}),
    (f.MatchAny("kiln", ["Quayside", "Mill"]), {2}),
    (f.Match("list[].x", 2), {1}),
    (f.Match("tags[]", "a"), {1}),
    (f.Exists("none"), {1}),
    (f.IsNull("none"), {1}),
    (f.IsEmpty("empty"), {1, 2, 5}),
    (f.Filter(should=[]), {1, 2, 5}),
    (f.Filter(should=[f.Match("kiln", "Mill"), f.Match("kiln", "Quayside")]), {2}),
    (f.Filter(must=[f.Filter(must_not=[f.Match("kiln", "Quayside")]), f.HasId([1, 2])]), {1}),
]


@pytest.mark.parametrize(("condition", "ids"), CASES, ids=range(len(CASES)))
def test_filters(spark, condition, ids):
    rows = spark.createDataFrame(PAYLOADS, "id long, j string").withColumn("payload", F.parse_json("j"))
    assert {r.id for r in f.where(rows, condition).collect()} == ids


def test_filter_fields():
    assert f.Filter(must=[f.Match("a.b", 1)], must_not=[f.Filter(should=[f.Range("c[].d")])]).fields() == {"a", "c"}
    assert (f.eq("x", "1") & ~f.gt("y", 2)).fields == {"x", "y"}


def test_metadata_algebra(spark):
    rows = spark.sql("SELECT map('shelf','upper','price','48.5','fired','true') AS m")
    for test, holds in ((f.eq("shelf", "upper"), True), (f.ne("shelf", "lower"), True), (f.ne("none", "x"), True), (f.gte("price", 40), True), (f.gte("price", 10) & f.lt("price", 50), True), (f.among("shelf", ["a"]), False), (f.contains("shelf", "Upp"), False), (f.gt("shelf", 1), False)):
        assert rows.select(test.column(F.col("m"))).first()[0] is holds


def test_dialects(spark, three):
    r = dialects.json_search({"vector": {"default": [1, 2]}, "limit": 3, "with_payload": {"exclude": ["x"]}, "filter": {"must": [{"key": "a", "match": {"value": 1}}]}})
    assert r.vector == [1, 2] and r.exclude_payload == ["x"] and r.filter.fields() == {"a"}
    g = dialects.graph_query('{ Get { Bowl(nearVector: {vector: [2.5, -1], certainty: 0.7}, limit: 2) { glaze kiln _additional { id distance certainty } } } }')
    assert (g.action, g.classes, g.fields, g.additional, g.vector, g.limit, g.certainty) == ("Get", ["Bowl"], ["glaze", "kiln"], ["id", "distance", "certainty"], [2.5, -1.0], 2, 0.7)
    assert dialects.graph_query("{ Aggregate { Bowl { meta { count } } } }").action == "Aggregate"
    rows = spark.range(5)
    assert [r.id for r in rows.where(dialects.expression("id > 0 and not id in [2, 3]")).collect()] == [1, 4]
    assert rows.where(dialects.expression("")).count() == 5
    for bad in ("id >", "id == 1 )", "1 == id", "id ~ 3"):
        with pytest.raises(ValueError):
            dialects.expression(bad)


def test_collection(spark, tmp_path):
    catalog = Catalog(spark, str(tmp_path))
    c = catalog.create("a-1", 2, metric="l2")
    for call in (lambda: catalog.create("a-1", 2), lambda: catalog.create("a b", 2), lambda: catalog.create("b", 0), lambda: catalog.open("zz")):
        with pytest.raises(ValueError):
            call()
    assert c.count() == 0
    c.upsert(spark.createDataFrame([(1, [1.0, 0.0], '{"k":1}', 0), (2, [0.0, 1.0], None, 1), (1, [2.0, 0.0], '{"k":2}', 2)], "id long, vector array<float>, payload string, pos int"), "pos")
    assert [(r.id, r.vector) for r in c.scan().collect()] == [(1, [2.0, 0.0]), (2, [0.0, 1.0])]
    for bad in ([(3, [1.0])], [(3, [1.0, float("nan")])], [(None, [1.0, 1.0])]):
        with pytest.raises(ValueError):
            c.upsert(spark.createDataFrame(bad, "id long, vector array<float>"))
    assert c.count() == 2
    full = c.snapshot("full")
    c.append(spark.createDataFrame([([5.0, 5.0],)], "vector array<float>"))
    c.delete([2])
    part = c.snapshot("part", since=full)
    assert {r.id for r in c.points().collect()} == {1, 3}
    c.restore(full)
    assert {r.id for r in c.points().collect()} == {1, 2}
    c.restore(part)
    assert {r.id for r in c.points().collect()} == {1, 3}
    with pytest.raises(ValueError):
        c.delete_snapshot(full)
    c.delete(condition=f.Match("k", 2))
    assert c.scroll(10)[1] is None and c.count() == 1 and c.get(3).count() == 1
    c.compact()
    assert c.count() == 1 and catalog.describe("a-1")["points"] == 1
    assert [r.id for r in c.search(search.Request([5.0, 5.0], metric="l2")).collect()] == [3]
    with pytest.raises(ValueError):
        c.search(search.Request([1.0]))
    assert catalog.update("a-1", note="x")["note"] == "x" and catalog.list() == ["a-1"]
    catalog.drop("a-1")
    catalog.drop("a-1")
    assert catalog.list() == []


def test_quantisers(spark):
    x = np.random.default_rng(42).normal(size=(400, 16))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")
    pq = quantize.Product.train(x, 4, 16)
    assert np.square(pq.decode(pq.encode(x)) - x).sum(1).mean() < np.square(x - x.mean(0)).sum(1).mean()
    assert pq.ratio() == 16
    codes = quantize.encoded(rows, pq)
    near = quantize.reranked(rows, codes, pq, [float(v) for v in x[3]], 5, 20)
    assert near.first().id == 3
    rq1, rq2 = (quantize.Residual.train(x, s, 16) for s in (1, 2))
    error = lambda q: np.square(q.decode(q.encode(x)) - x).mean()
    assert error(rq2) < error(rq1)
    assert error(quantize.Additive(rq2.books)) <= error(rq2) + 1e-12
    assert error(quantize.Stacked.train(x, 2)) < error(quantize.Product.train(x, 4, 16))
    assert one(spark, quantize.binary_codes([1.0, -1.0, 0.0, 2.0, 0, 0, 0, 0, 3.0])) == [9, 1]
    assert one(spark, quantize.int8_codes([0.5, -0.5, 200.0], 1.0)) == [1, -1, 127]
    assert one(spark, quantize.scalar_codes([0.5, 2.0, 7.0], [0.0, 0.0, 7.0], [1.0, 1.0, 7.0])) == [127, 255, 0]
    assert one(spark, quantize.from_deltas(quantize.deltas(F.array(*(F.lit(v).cast("long") for v in (3, 7, 12)))))) == [3, 7, 12]
    with pytest.raises(ValueError):
        quantize.Product.train(x, 5)


def test_list_index_recall(spark):
    x = np.random.default_rng(1).normal(size=(1000, 16))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vector array<float>")
    lists = index.Lists.train(rows, 16)
    assigned = lists.assigned(rows).cache()
    hits = 0
    for q in range(0, 50, 10):
        exact = np.argsort(np.square(x - x[q]).sum(1), kind="stable")[:10]
        hits += len({r.id for r in lists.search(assigned, x[q].tolist(), 10, 12).collect()} & set(exact.tolist()))
    assert hits >= 45
    assert [index.advice(n, 64) for n in (100, 10**5, 10**7)] == ["flat", "lists", "lists, high recall"]
    assert index.advice(10**6, 1536, 100) == "lists with product codes"


def test_learned_index(spark):
    model = index.learned(spark.range(1000).select((F.col("id") / 10).alias("k")), "k").collect()
    assert 400 < one(spark, index.predicted(model, F.lit(50.0))) < 600
    assert one(spark, index.predicted(model, F.lit(-9.0))) == 0


def test_udfs(spark, three):
    udfs.load_module("m", {"neg": lambda a, b: -V.euclidean(a, b)})
    assert search.custom(three, [2.0, 1.0, -0.5, 5.0], udfs.function("m", "neg"), 1).first().id == 1
    assert search.custom(three, [2.0, 1.0, -0.5, 5.0], udfs.function("m", "none"), 1).first().score == 0
    udfs.register(spark, "sim", lambda a, b: (a * b).sum(1))
    assert spark.sql("SELECT sim(array(1D, 2D), array(3D, 4D))").first()[0] == 11
