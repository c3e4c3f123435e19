import datetime as dt
import json
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sagitta.functions import records, text
from sagitta.operators import cache, graph, history, ordering, replication, ring
from sagitta.sources import backup, binary, checkpoints, connectors, formats
from sagitta.streaming import changes

INTENTS = {
    "What is a fjord?": "Definitional", "Meaning of tundra": "Definitional", "How to mend a net?": "Procedural", "Steps for tanning hides": "Procedural", "A guide to knots": "Procedural",
    "Compare wool with linen": "Comparative", "Oak versus ash": "Comparative", "Why do geese fly south?": "Causal", "The reason for tides": "Causal", "List lakes of Finland": "Aggregational",
    "Every bridge in town": "Aggregational", "When did the ferry stop?": "Temporal", "The latest tide table": "Temporal", "Who built the pier?": "Factual", "Really?": "Factual", "Hm": "Unknown",
}


def values(spark, texts, column):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column).collect()]


def test_intents(spark):
    assert values(spark, INTENTS, text.intent(F.col("t"))) == list(INTENTS.values())
    assert values(spark, [None], text.intent(F.col("t"))) == [None]


def test_entities(spark):
    got = values(spark, ["Who sailed to Lake Ladoga?", "was it Harbour Trust Limited?", "UNESCO sent it", "x Port of the North and y", "a B"], text.query_entities(F.col("t")))
    assert got == [["Lake Ladoga"], ["Harbour Trust Limited"], [], ["Port of the North and"], []]
    assert values(spark, ["The Big dog, Ann  Lee."], text.document_entities(F.col("t"))) == [["The Big", "Ann  Lee."]]


def test_expansion_and_stems(spark):
    assert values(spark, ["fast car"], text.expansions(F.col("t"))) == [["fast car", "quick car", "rapid car", "speedy car", "swift car"]]
    assert values(spark, ["Boxes", "walking", "s"], text.variations(F.col("t"))) == [["Boxes", "boxe", "box"], ["walking", "walk"], ["s"]]


def test_plans(spark):
    got = values(spark, ["Compare the size of the Rome and x Paris", "Was it in the Rome or Paris?", "hello"], text.plan(F.col("t")))
    assert [s.step_type for s in got[0]] == ["Retrieve", "Retrieve", "Aggregate"] and got[0][2].dependencies == [0, 1]
    assert [(s.query, s.dependencies) for s in got[1]] == [("Rome", []), ("Paris", [0])]
    assert got[2] is None


def test_register(spark):
    rows = [(1, "k", "write", 1), (2, "k", "read", 1), (3, "k", "read", 2), (4, "k", "write", None), (5, "k", "read", None), (6, "z", "read", 5)]
    bad = history.register_violations(spark.createDataFrame(rows, "i int, key string, kind string, v int"), "key", ["i"], "kind", "v")
    assert sorted(r.i for r in bad.collect()) == [3, 6]


def plain_replay(ops):
    """The operations, in order, that a register contradicts, with its value before them."""
    state, out = {}, []
    for i, key, kind, new, old, ok in ops:
        now = state.get(key)
        if ok and (kind == "read" and new != now or kind == "cas" and old != now):
            out.append((i, now))
        if ok and kind in ("write", "cas"):
            state[key] = new
    return out


def test_replay_with_compare_and_set(spark):
    ops = [(1, "k", "read", None, None, True), (2, "k", "write", 1, None, True), (3, "k", "cas", 2, 1, True), (4, "k", "read", 2, None, True), (5, "k", "cas", 3, 1, False), (6, "k", "read", 2, None, True), (7, "k", "cas", 5, 9, True), (8, "k", "read", 4, None, True), (9, "j", "read", 2, None, True), (10, "j", "other", 2, None, True)]
    got = history.replayed(spark.createDataFrame(ops, "i int, key string, kind string, v int, old int, ok boolean"), "key", ["i"], "kind", "v", "old", "ok")
    assert sorted((r.i, r.expected) for r in got.collect()) == sorted(plain_replay(ops)) == [(7, 2), (8, 5), (9, None)]


def test_replay_of_the_events(spark):
    from sagitta import queries

    sf = "/root/testdata/sf0.001"
    kinds = {"purchase": "write", "signup": "cas", "error": "other"}
    events = spark.read.parquet(f"{sf}/events.parquet").orderBy("event_id").collect()
    ops = [(e.event_id, e.user_id % 20, kinds.get(e.event_type, "read"), int(e.value // 1) % 3, e.event_id % 3, e.event_id % 5 != 0) for e in events]
    assert sorted((r.event_id, r.expected) for r in queries.QUERIES["register_replay"](spark, sf).collect()) == sorted(plain_replay(ops))


def test_running_sums_over_ranges(spark):
    rows = [(None if k % 11 == 0 else k % 3, k * 7919 % 1009, k) for k in range(500)]
    got = ordering.running(spark.createDataFrame(rows, "g int, o int, w long").repartition(6), ["g"], ["o"], {"sum": F.col("w"), "no": F.lit(1).cast("long")}).collect()
    for g in {r[0] for r in rows}:
        total = 0
        for n, (_, o, w) in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1]), 1):
            total += w
            assert [(r.sum, r.no) for r in got if r.g == g and r.o == o] == [(total, n)]
    assert sorted(r.n for r in ordering.placed(spark.range(100, numPartitions=7).where("id % 3 = 0"), "n").collect()) == list(range(34))
    empty = spark.createDataFrame([], "g int, o int, w long")
    assert ordering.numbered(empty, ["g"], ["o"], "no").count() == ordering.placed(empty, "n").count() == 0


def test_windows_in_blocks(spark):
    rows = spark.createDataFrame([(k % 2, k) for k in range(60)], "g int, o int")
    at = ordering.blocks(rows, ["g"], ["o"], 3, 2, size=4)
    held = at.groupBy("g", "_block").agg(F.sort_array(F.collect_list("o")).alias("o"), F.sort_array(F.collect_list(F.when(~F.col("_guest"), F.col("o")))).alias("own")).collect()
    for r in held:
        own = range(r.g + 8 * r["_block"], min(60, r.g + 8 * (r["_block"] + 1)), 2)
        if not own:  # guests of a block behind the last one
            assert r.own == []
            continue
        assert r.own == list(own) and r.o == [x for x in range(min(own) - 6, max(own) + 5, 2) if 0 <= x < 60]
    assert text.context(rows, "g", "o", 2, 1).where("o = 9").first()[2:] == ([5, 7], [11]) and text.context(rows, "g", "o").count() == 60


def test_conflicts_meet_in_blocks(spark):
    rows = spark.createDataFrame([(t, [t % 3, 10 + t % 5]) for t in range(40)], "t int, keys array<int>")
    pairs = {(r.a, r.b) for r in history.conflicts(rows, "t", "keys").collect()}
    assert pairs == {(a, b) for a in range(40) for b in range(a + 1, 40) if a % 3 == b % 3 or a % 5 == b % 5}
    a, b = ordering.block_pairs(spark.createDataFrame([(1, v) for v in range(50)], "k int, v int"), "k", "v", 7)
    met = [tuple(sorted((r.v, r.w))) for r in a.join(b.withColumnRenamed("v", "w"), ["k", "_i", "_j"]).where("_i != _j or v < w").collect()]
    assert len(met) == len(set(met)) == 50 * 49 // 2
    cliques = history.cliques(rows, "t", "keys").collect()
    assert {(r.key, r.t, r.first, r.others) for r in cliques} == {(k, t, k % 10 if k >= 10 else k, (8 if k >= 10 else 14 if k == 0 else 13) - 1) for t in range(40) for k in (t % 3, 10 + t % 5)}


def test_ring(spark):
    rows = spark.range(2000).withColumnRenamed("id", "key")
    whole = {r.key: r.node for r in ring.Ring(["a", "b", "c"]).assigned(rows, "key").collect()}
    less = {r.key: r.node for r in ring.Ring(["a", "b", "c"]).remove("b").assigned(rows, "key").collect()}
    assert all(less[k] == n for k, n in whole.items() if n != "b") and set(less.values()) == {"a", "c"}
    two = ring.Ring(["a", "b", "c"]).preferred(rows, "key", 2).collect()
    assert all(r.nodes[0] == whole[r.key] and len(set(r.nodes)) == 2 for r in two)
    counts = {r.node: r.n for r in ring.Ring(["a", "b", "c"]).add("d").distribution(rows, "key").collect()}
    assert set(counts) == set("abcd") and sum(counts.values()) == 2000 and min(counts.values()) > 200
    assert ring.Ring([]).assigned(rows, "key").where("node is not null").count() == 0


def test_limiter(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("a", t + dt.timedelta(seconds=s)) for s in (0, 1, 2, 9, 10, 11)] + [("b", t)], "u string, ts timestamp")
    got = history.window_limited(rows, "u", "ts", 2, 10).orderBy("u", "ts").collect()
    assert [r.allowed for r in got] == [True, True, False, False, True, True, True]


def test_throughput_has_empty_windows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(t,), (t + dt.timedelta(seconds=25),)], "ts timestamp")
    assert [r["count"] for r in history.throughput(rows, "ts", 10).orderBy("start").collect()] == [1, 0, 1]
    assert history.statistics(rows.limit(0).withColumn("v", F.lit(1.0)), "v", ["ts"]).count() == 0


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 5), (5, 4), (9, 9)], "src long, dst long")
    assert graph.shortest_path(edges, 1, 4) == [1, 5, 4]
    assert graph.shortest_path(edges, 1, 9) is None
    assert graph.shortest_path(edges, 1, 1) == [1]
    ranks = {r.node: r["rank"] for r in graph.page_rank(edges.where("src != 9"), turns=20).collect()}
    assert max(ranks, key=ranks.get) == 4


def test_clocks(spark):
    rows = spark.sql("SELECT map('a', 1L, 'b', 2L) AS x, map('a', 2L) AS y, map('a', 1L, 'b', 2L, 'c', 0L) AS z")
    got = rows.select(replication.compared(F.col("x"), F.col("y")), replication.compared(F.col("x"), F.col("z")), replication.compared(F.map_from_arrays(F.array(F.lit("a")), F.array(F.lit(1).cast("long"))), F.col("y")), replication.merged(F.col("x"), F.col("y"))).first()
    assert tuple(got)[:3] == ("Concurrent", "Equal", "Less") and got[3] == {"a": 2, "b": 2}


def test_custom_resolver(spark):
    ops = spark.createDataFrame([(1, "k", 5), (2, "k", 9)], "op_id long, key string, v long")
    assert replication.custom(ops, lambda p: p[p.v == p.v.max()]).first().op_id == 2


ROWS = [("test1", [1.0, 2.0, 3.0, 4.0], '{"category":"tech","score":0.9}'), ('q"2', [5.5, 6.0, 7.0, 8.0], '{"category":"a, b","score":1.0}'), ("test3", [9.0, 10.0, 11.0, 12.0], None)]


@pytest.mark.parametrize("kind", sorted(formats.READERS))
def test_formats_keep_records(spark, tmp_path, kind):
    rows = spark.createDataFrame(ROWS, "id string, vector array<float>, metadata string")
    path = str(tmp_path / f"x.{kind}")
    formats.WRITERS[kind](rows, path)
    got = {r.id: r for r in formats.READERS[kind](spark, path).withColumn("m", F.parse_json("metadata")).withColumn("category", F.try_variant_get("m", "$.category", "string")).collect()}
    assert {k: list(v.vector) for k, v in got.items()} == {i: v for i, v, _ in ROWS}
    assert got["test1"].category == "tech" and got['q"2'].category == "a, b"


def test_format_rules(spark, tmp_path):
    assert [formats.format_of(p) for p in ("a.jsonl", "b.NDJSON", "c.h5", "d.bin", "e.txt")] == ["jsonl", "jsonl", "hdf5", "binary", None]
    with pytest.raises(ValueError):
        formats.check_conversion("csv", "binary")
    (tmp_path / "l.jsonl").write_text('{"_id": 7, "embedding": [1, 2], "a": 1}\n\n{"x": 2}\n')
    got = [(r.id, r.vector) for r in formats.read_jsonl(spark, str(tmp_path / "l.jsonl"), strict=False).collect()]
    assert got == [("7", [1.0, 2.0]), ("unknown", [])]
    with pytest.raises(Exception, match="text id"):
        formats.read_jsonl(spark, str(tmp_path / "l.jsonl")).collect()
    (tmp_path / "c.csv").write_text('id,vector,n,flag\na,"[1.0, 2.0]",3,true\nb,1;2,x,\n')
    got = {r.id: r.metadata for r in formats.read_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"a": '{"n":3,"flag":true}', "b": '{"n":"x"}'}
    assert formats.convert(spark, str(tmp_path / "c.csv"), str(tmp_path / "o.parquet")) == 2
    assert formats.parquet_info(spark, str(tmp_path / "o.parquet")).agg(F.sum("rows")).first()[0] == 2


def test_binary_format():
    raw = binary.MAGIC + (1).to_bytes(4, "little") + (1).to_bytes(8, "little") + binary.packed("é", [1.5], None)
    assert list(binary.unpacked(raw)) == [("é", [1.5], None)]
    for bad in (raw[:-3], b"XXXX" + raw[4:], raw[:4] + b"\x02" + raw[5:]):
        with pytest.raises(ValueError):
            list(binary.unpacked(bad))


def test_validation(spark):
    rows = spark.createDataFrame([("ok", [1.0, 2.0], {"k": "v"}), ("", [1.0, 2.0], {}), ("a/b", [1.0], {"1x": "v"}), ("n", [float("inf"), 1.0], {}), (None, [], None)], "id string, v array<float>, m map<string,string>")
    got = [set(r[0]) for r in rows.select(records.errors(F.col("id"), F.col("v"), F.col("m"), 2)).collect()]
    assert got[0] == set() and got[1] == {"empty id"} and got[2] == {"bad id", "dimension", "bad key"} and got[3] == {"not finite"} and got[4] >= {"empty id", "empty vector"}
    p = spark.createDataFrame([('{"a":1,"b":"x","c":[1]}',)], "j string").select(F.parse_json("j").alias("p"))
    assert p.select(records.schema_errors(F.col("p"), {"a": "Number", "b": "Number", "d": "Array"})).first()[0] == ["type of b", "missing d", "unexpected c"]
    assert p.select(records.duration(F.lit(3725)), records.duration(F.lit(59))).first() == ("1h 2m 5s", "59s")


def test_change_stream(spark, tmp_path):
    schema = "id long, vector array<float>"
    one = spark.createDataFrame([(1, [1.0]), (2, [2.0])], schema)
    two = spark.createDataFrame([(2, [3.0]), (3, [4.0])], schema)
    log, out, mark = (str(tmp_path / n) for n in ("log", "out", "mark"))
    first = changes.difference(spark.createDataFrame([], schema), one, "c", "t1")
    changes.append(first, log)
    changes.materialise(changes.subscribe(spark, log, "c"), out, mark).awaitTermination()
    second = changes.difference(one, two, "c", "t2", start=first.count())
    assert [(r.vector_id, r.change_type, r.sequence) for r in second.orderBy("sequence").collect()] == [(1, "delete", 2), (2, "update", 3), (3, "insert", 4)]
    changes.append(second, log)
    changes.materialise(changes.subscribe(spark, log, "c"), out, mark).awaitTermination()
    state = spark.read.parquet(f"{out}/v1").where("not deleted")
    assert {r.vector_id: list(r.vector) for r in state.collect()} == {2: [3.0], 3: [4.0]}
    assert {r.vector_id for r in changes.state(spark.read.schema(changes.EVENT).parquet(log)).collect()} == {2, 3}


def test_stream_limiter_keeps_state(spark, tmp_path):
    src = str(tmp_path / "src")
    t = pd.Timestamp("2024-01-01")
    stream = None
    for k, s in enumerate((0, 1, 2)):
        spark.createDataFrame(pd.DataFrame({"u": ["a"], "ts": [t + pd.Timedelta(seconds=s)]})).coalesce(1).write.mode("append").parquet(src)
        stream = stream or changes.limited(spark.readStream.schema("u string, ts timestamp").parquet(src), "u", "ts", 2, 10)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o")).awaitTermination()
    assert [r.allowed for r in spark.read.parquet(str(tmp_path / "o")).orderBy("at").collect()] == [True, True, False]


def test_stream_limiter_orders_a_batch(spark, tmp_path):
    """Rows of a key that come in many frames, out of order, are limited as the batch form limits them."""
    src, t = str(tmp_path / "src"), pd.Timestamp("2024-01-01")
    frame = pd.DataFrame({"u": ["a"] * 60, "ts": [t + pd.Timedelta(seconds=k * 37 % 60) for k in range(60)]})
    spark.createDataFrame(frame).coalesce(1).write.parquet(src)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    kept = spark.conf.get(name)
    spark.conf.set(name, "10")
    try:
        stream = changes.limited(spark.readStream.schema("u string, ts timestamp").parquet(src), "u", "ts", 3, 10)
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "o")).awaitTermination()
    finally:
        spark.conf.set(name, kept)
    want = history.window_limited(spark.read.parquet(src), "u", "ts", 3, 10)
    assert sorted((r["at"], r.allowed) for r in spark.read.parquet(str(tmp_path / "o")).collect()) == sorted((r.ts, r.allowed) for r in want.collect())


def test_connectors(spark, tmp_path):
    points = [{"id": i, "vector": {"default": [i, 1]} if i % 2 else [i, 1], "payload": {"k": i}} for i in range(5)]

    def scroll(offset, limit):
        at = offset or 0
        return {"result": {"points": points[at : at + limit], "next_page_offset": at + limit if at + limit < 5 else None}}

    got = connectors.imported(spark, scroll, "scroll", str(tmp_path / "a"), 2).orderBy("id").collect()
    assert [(r.id, r.vector[0], r.metadata) for r in got] == [(str(i), float(i), f'{{"k": {i}}}') for i in range(5)]
    rows = [{"id": i, "embedding": [1.0], "tag": "x"} for i in range(4)]
    assert sum(map(len, connectors.pages(lambda o, n: {"data": rows[o : o + n]}, "entities", 2))) == 4
    graph_rows = {"data": {"Get": {"A": [{"t": "x", "_additional": {"id": "u", "vector": [1, 2]}}]}}}
    assert list(connectors.pages(lambda o, n: graph_rows, "graph")) == [[("u", [1.0, 2.0], '{"t": "x"}')]]
    assert list(connectors.pages(lambda o, n: {"matches": [{"id": "m", "values": [3]}]}, "matches")) == [[("m", [3.0], None)]]
    out = tmp_path / "sent"
    out.mkdir()

    def send(batch):
        (out / uuid.uuid4().hex).write_text(json.dumps(batch))

    connectors.exported(spark.read.parquet(str(tmp_path / "a")), send, 2)
    assert sum(len(json.loads(p.read_text())) for p in out.iterdir()) == 5


def test_backup(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "d"))
    name = backup.create(spark, str(tmp_path / "d"), str(tmp_path / "b"), "one")
    spark.range(9).write.mode("overwrite").parquet(str(tmp_path / "d"))
    backup.restore(spark, str(tmp_path / "b"), name, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 3 and [b["name"] for b in backup.listed(spark, str(tmp_path / "b"))] == ["one"]
    with pytest.raises(ValueError):
        backup.create(spark, str(tmp_path / "d"), str(tmp_path / "b"), "one")


def test_result_cache(spark):
    now = [0.0]
    kept = cache.Results(2, 10, lambda: now[0])
    first = kept.get("a", lambda: spark.range(1), 1)
    assert kept.get("a", lambda: spark.range(2), 1) is first and kept.get("a", lambda: spark.range(2), 2).count() == 2
    now[0] = 20
    assert kept.get("a", lambda: spark.range(3), 2).count() == 3
    for k in "bc":
        kept.get(k, lambda: spark.range(1))
    assert kept.statistics() == {"entries": 2, "hits": 1, "misses": 5, "hit_rate": pytest.approx(1 / 6)}
    kept.clear()


def test_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "src long, dst long")
    assert graph.on_cycles(edges).count() == 0
    assert graph.on_cycles(edges.union(spark.createDataFrame([(3, 1)], edges.schema))).count() == 3


def test_long_chains_are_no_cycles(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(104)], "src long, dst long")
    assert graph.on_cycles(chain).count() == 0


def test_checkpoints(spark, tmp_path):
    c = checkpoints.Checkpoints(spark, str(tmp_path / "c"))
    assert c.load("a") is None and c.list() == []
    c.save("a", 10, 10, source="x")
    c.save("a", 20, 19, 1)
    c.save("b", 5, 5)
    assert c.load("a")["offset"] == 20 and c.statistics() == {"jobs": 2, "processed": 24, "failed": 1}
    assert c.remove_older(3600) == 0 and c.remove("a") and [x["job"] for x in c.list()] == ["b"]
