"""Near-duplicate documents: MinHash bands propose pairs, odd sketches screen them, full shingle sets confirm them.

A document's set is its distinct 5-word shingles (A-Z folded); one of fewer words has its whole sequence as one.
Equal sets are one node from the start, so copies cost nothing more. Each node has ``BANDS`` band keys of ``ROWS`` MinHash
values, and an odd sketch: every MinHash sample flips one bit of a parity bitmap, so that the number of bits in which two
bitmaps differ estimates, closely at high similarity, how many samples differ. Documents of similarity 0.75 share a band
but for 2 in 100,000 pairs, and pass the screen, four standard errors wide, in all but rare cases; more similar ones
are rarer still to be lost. Every link is confirmed by intersecting the full sets.

A bucket of nodes that share a band is never paired off: each round links its members to one leader (a random one in
later rounds), components are formed, and buckets within one component are done with. Only buckets that the rounds leave
with several components are compared across those components. A large one is split into blocks, and each pair of blocks is
dealt on its own, so no task has all of a bucket. Sketches first tell which nodes may have a link there at all; only
these bring their sets, and a pair is a row only if it is a link.

Null texts and texts without words have the empty set, link with nothing and form their own component. Rows with one
id are rows of their own. A null id never names a component that has another. Texts are read whole, an empty table gives
an empty result, extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sagitta.llm.common import BYTE_CODES, LOWER, blocks, counted, cut, done, mixed, read, shingle_hashes, utf8, word_hashes, word_spans

WORDS = 5
#: Similarity at least, in hundredths.
LEAST = 75
BANDS, ROWS = 40, 5
SKETCH_BITS = 512
#: Rounds of leaders at most; they end when a later one finds fewer links than this share of the nodes still open.
ROUNDS = 3
FEW = 0.1
#: Up to so many rows (with a sketch about 250 bytes each) are sent to all executors; beyond, the join is a shuffle. The driver
#: holds what it sends several times over: as it was collected, as a table that grows by doubling, and in blocks.
BROADCAST_ROWS = 100_000
#: Nodes of a bucket that are compared with one another in one task, about.
BLOCK_NODES = 1024

_rng = np.random.default_rng(20)
MULTIPLIERS = _rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint32) | np.uint32(1)
SAMPLE_CODES = mixed(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))


def screen_bits(least: int = LEAST, errors: float = 4.0) -> int:
    """The most bits in which the sketches of two documents of the least similarity may differ, by so many errors."""
    n, k, j = SKETCH_BITS, BANDS * ROWS, least / 100
    expected = lambda d: n / 2 * (1 - np.exp(-2 * d / n))
    d = 2 * k * (1 - j) + errors * 2 * np.sqrt(k * j * (1 - j))
    return int(np.ceil(expected(d) + errors * np.sqrt(expected(d) * (1 - expected(d) / n)) / 2))


def sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' shingle sets, each in ascending order, one after the other, and their offsets."""
    low = LOWER[data]
    s, e, first = word_spans(low, offs)
    h, at = shingle_hashes(word_hashes(low, s, e), first, WORDS)
    parts = [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return np.concatenate(parts) if parts else h, np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)


def signatures(values: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of non-empty sets: band keys, and odd sketches as rows of 64-bit words."""
    n, start = len(at) - 1, at[:-1]
    low, high = values.astype(np.uint32), (values >> np.uint64(32)).astype(np.uint32)
    samples = np.empty((BANDS * ROWS, n), np.uint64)
    for k, a in enumerate(MULTIPLIERS):
        samples[k] = np.minimum.reduceat(low * a + high, start)
    samples = mixed(samples + SAMPLE_CODES[:, None])
    keys = mixed(samples.reshape(BANDS, ROWS, n).cumsum(axis=1, dtype=np.uint64)[:, -1] + SAMPLE_CODES[:BANDS, None])
    bit = (samples % np.uint64(SKETCH_BITS)).astype(np.int64) + np.arange(n) * SKETCH_BITS
    flips = np.bincount(bit.ravel(), minlength=n * SKETCH_BITS).reshape(n, SKETCH_BITS)
    sketch = np.packbits((flips & 1).astype(bool), axis=1).view(np.int64)
    return keys.T.copy().view(np.int64), sketch


def node_keys(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit key of each non-empty set, from the sum and the number of its members."""
    return mixed(np.add.reduceat(mixed(values + BYTE_CODES[7]), at[:-1]) + mixed(np.diff(at).astype(np.uint64))).view(np.int64)


def sketched(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, key (its text's hash), n_shingles, node (its set's key), bands and sketch (null for an empty set)."""
    names = ["doc_id", "key", "n_shingles", "node", "bands", "sketch"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(1))
            for a, b, part, at in blocks(data, offs):
                values, place = sets(part, at)
                size = np.diff(place)
                full = size > 0
                node, keys, odd = np.zeros(b - a, np.int64), None, None
                lists = [pa.nulls(b - a, pa.list_(pa.int64()))] * 2
                if full.any():
                    kept = np.concatenate([place[:-1][full], place[-1:]])
                    node[full] = node_keys(values, kept)
                    keys, odd = signatures(values, kept)
                    for i, x in enumerate((keys, odd)):
                        ends = np.concatenate([[0], np.cumsum(full * x.shape[1])]).astype(np.int32)
                        lists[i] = pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel()), mask=pa.array(~full))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(size), pa.array(node, mask=~full), *lists], names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(work, "doc_id long, key long, n_shingles long, node long, bands array<long>, sketch array<long>")


def shingled(docs: DataFrame) -> DataFrame:
    """For each row with words: node and its full set."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs = utf8(batch.column(0))
            for _, _, part, at in blocks(data, offs):
                values, place = sets(part, at)
                full = np.diff(place) > 0
                if full.any():
                    kept = np.concatenate([place[:-1][full], place[-1:]])
                    yield pa.RecordBatch.from_arrays([pa.array(node_keys(values, kept)), pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(values.view(np.int64)))], ["node", "members"])

    return docs.select("text").mapInArrow(work, "node long, members array<long>")


def sent(rows: DataFrame, n: int) -> DataFrame:
    """rows, marked to be sent to all executors if they are n at most BROADCAST_ROWS; else a join with them is a shuffle."""
    return F.broadcast(rows) if n <= BROADCAST_ROWS else rows


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is its component's smallest node.

    Large and small stars in turn: every pass is joins and aggregations, and a node of many edges is no group of its own.
    """
    def stars(pairs: DataFrame, n: int, large: bool) -> DataFrame:
        both = pairs.select(F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))) if large else pairs
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        far = both.join(sent(least, 2 * n if large else n), "u").where(F.col("v") > F.col("u") if large else F.col("v") != F.col("m"))
        far = far.select(F.col("v").alias("u"), F.col("m").alias("v"))
        if not large:
            far = far.union(least.select("u", F.col("m").alias("v")))
        return far.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))

    hashes = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    now, *before = counted(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges", hashes)
    n = before[0]
    while True:
        # each star is written: one plan of both would hold the large one, and all that it reads, several times
        large, m = counted(stars(now, n, True), "large-stars")
        done(now)
        now, *mark = counted(stars(large, m, False).distinct(), "stars", hashes)
        done(large)
        if mark == before or not mark[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, n = mark, mark[0]


def _near(a: str, b: str, least: int) -> Column:
    """Whether sizes and sketches of two nodes, columns with these prefixes, allow a link."""
    words = SKETCH_BITS // 64
    differ = sum((F.bit_count(F.col(f"{a}sketch")[k].bitwiseXOR(F.col(f"{b}sketch")[k])) for k in range(words)), F.lit(0))
    n, m = F.col(f"{a}n"), F.col(f"{b}n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * least) & (differ <= screen_bits(least))


def full_sets(wanted: DataFrame, docs: DataFrame, origin: DataFrame) -> DataFrame:
    """node and its whole set (members) for the wanted nodes. origin has a row (node, doc_id) for each node."""
    nodes, n = counted(wanted.select("node").distinct(), "wanted")
    # a node whose rows all have a null id is fetched by it too
    ids = origin.join(sent(nodes, n), "node").select(F.col("doc_id").alias("_id")).distinct()
    texts = docs.join(sent(ids, n), F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    members, found = counted(shingled(texts).join(sent(nodes, n), "node", "left_semi"), "members")
    if found != n:
        members, old = cut(members.dropDuplicates(["node"]), "members"), members
        done(old)
    done(nodes)
    return members


def _linked(a: str, b: str, least: int) -> Column:
    """Whether two whole sets, array columns, are similar enough."""
    common = F.size(F.array_intersect(a, b))
    return common * (100 + least) >= (F.size(a) + F.size(b)) * least


def confirmed(pairs: DataFrame, docs: DataFrame, origin: DataFrame, least: int) -> tuple[DataFrame, int]:
    """Those pairs (u, v) of nodes whose full sets are similar enough, and how many they are."""
    pairs = cut(pairs, "pairs")
    members = full_sets(pairs.select(F.col("u").alias("node")).union(pairs.select("v")), docs, origin)
    both = pairs.join(members.select(F.col("node").alias("u"), F.col("members").alias("a")), "u").join(members.select(F.col("node").alias("v"), F.col("members").alias("b")), "v")
    links, n = counted(both.where(_linked("a", "b", least)).select("u", "v"), "links")
    done(pairs, members)
    return links, n


def block_pairs(live: DataFrame, block_nodes: int = BLOCK_NODES) -> tuple[DataFrame, DataFrame]:
    """live twice, its columns with u_ and v_ before their names, dealt to units: a bucket's pairs of blocks.

    Every pair of a bucket's nodes stands in just one unit, the one of its two blocks.
    """
    sizes, n = counted(live.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / block_nodes).alias("blocks")), "sizes")
    rows = live.join(sent(sizes, n), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    kept = [c for c in live.columns if c != "bucket"]

    def side(prefix: str, others: Column, first: Column, second: Column) -> DataFrame:
        dealt = rows.withColumn("other", F.explode(others)).withColumns({"i": first, "j": second})
        return dealt.select("bucket", "i", "j", *(F.col(c).alias(prefix + c) for c in kept))

    return side("u_", F.sequence(F.col("block"), F.col("blocks") - 1), F.col("block"), F.col("other")), side("v_", F.sequence(F.lit(0).cast("long"), F.col("block")), F.col("other"), F.col("block"))


def across(live: DataFrame, nodes: DataFrame, docs: DataFrame, origin: DataFrame, least: int) -> DataFrame:
    """All links (u, v) between different parts of one bucket of live.

    The joins' own conditions judge a pair, so none is a row that is no link, and a link is one at the first band that both
    share. Nodes without any pair that the sketches let pass are left out before sets are fetched.
    """
    same = lambda u, v: (u["bucket"] == v["bucket"]) & (u["i"] == v["i"]) & (u["j"] == v["j"])
    # within a block each pair is met from both sides
    cheap = ((F.col("i_") != F.col("j_")) | (F.col("u_node") < F.col("v_node"))) & (F.col("u_part") != F.col("v_part")) & _near("u_", "v_", least)
    first = F.array_position(F.zip_with("u_bands", "v_bands", lambda x, y: x == y), True) == F.col("u_band") + 1

    def sides(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        u, v = block_pairs(rows)
        return u.withColumns({"i_": F.col("i"), "j_": F.col("j")}), v

    u, v = sides(live)
    open_ = u.join(v, same(u, v) & cheap, "left_semi").select(F.col("u_node").alias("node")).union(v.join(u, same(u, v) & cheap, "left_semi").select(F.col("v_node").alias("node")))
    open_, n = counted(open_.distinct(), "open")
    if not n:
        return open_.select(F.col("node").alias("u"), F.col("node").alias("v"))
    members = full_sets(open_, docs, origin)
    u, v = sides(live.join(members, "node").join(nodes.select("node", "bands"), "node"))
    link = F.when(~cheap, False).when(~first, False).otherwise(_linked("u_members", "v_members", least))
    links = cut(u.join(v, same(u, v) & link).select(F.col("u_node").alias("u"), F.col("v_node").alias("v")), "links")
    done(open_, members)
    return links


def labelled(docs: DataFrame, least: int = LEAST, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, int]:
    """Rows (doc_id, key, n_shingles, node) and, for every node, (node, root, component_id), and the number of nodes."""
    docs = docs.select("doc_id", "text")
    rows = cut(sketched(docs), "sketched")
    nodes = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    nodes = cut(nodes, "nodes")
    origin = nodes.select("node", "doc_id")
    entries = nodes.select("node", F.posexplode("bands").alias("band", "value")).select("node", "band", F.xxhash64("band", "value").alias("bucket"))
    shared, n = counted(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1").select("bucket"), "shared")
    # only what shares a bucket with others carries its sketch
    live = cut(entries.join(sent(shared, n), "bucket").join(nodes.select("node", "n", "sketch"), "node").withColumn("part", F.col("node")), "entries")
    done(shared)
    roots, links, last = None, None, False
    for turn in range(rounds + 1):
        last = last or turn == rounds
        if last:
            found = across(live, nodes, docs, origin, least)
        else:
            rank = F.col("node") if not turn else F.xxhash64(F.lit(turn), F.col("node"))
            leaders = live.groupBy("bucket").agg(F.min(F.struct(rank.alias("rank"), "node", "part", "n", "sketch")).alias("lead"))
            leaders, n = counted(leaders.select(F.col("bucket").alias("l_bucket"), *(F.col(f"lead.{c}").alias(f"l_{c}") for c in ("node", "part", "n", "sketch"))), "leaders")
            pairs = live.join(sent(leaders, n), (F.col("bucket") == F.col("l_bucket")) & (F.col("part") != F.col("l_part")) & _near("", "l_", least))
            found, new = confirmed(pairs.select(F.least("node", "l_node").alias("u"), F.greatest("node", "l_node").alias("v")).distinct(), docs, origin, least)
            done(leaders)
        links = found if links is None else roots.select(F.col("node").alias("u"), F.col("root").alias("v")).union(found)
        roots = components(links)
        if last:
            break
        named = live.drop("part").join(roots, "node", "left").withColumn("part", F.coalesce("root", "node")).drop("root")
        parts = cut(named.select(*live.columns), "parts")
        # two members: their one pair is settled
        open_ = parts.groupBy("bucket").agg(F.min("part").alias("a"), F.max("part").alias("b"), F.count(F.lit(1)).alias("size")).where("a != b and size > 2").select("bucket")
        open_, n = counted(open_, "open")
        live, old = cut(parts.join(sent(open_, n), "bucket", "left_semi"), "live"), live
        done(old, parts, open_)
        left = live.agg(F.count_distinct("node")).first()[0]
        if not left:
            break
        # leaders that find few links more have done their part
        last = turn > 0 and new < FEW * left
    done(live)
    named = origin.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    least_id, n = counted(named.groupBy("root").agg(F.min("doc_id").alias("component_id")), "least-ids")
    labels, n = counted(named.join(sent(least_id, n), "root").select("node", "root", "component_id"), "labels")
    done(least_id)
    done(nodes)
    return rows.select("doc_id", "key", "n_shingles", "node"), labels, n


def classes(docs: DataFrame, least: int = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach) and kept, for each row of docs."""
    rows, labels, n = labelled(docs, least, rounds)
    out = rows.join(sent(labels, n), "node", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def survivors(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, key (xxhash64 of the text), rows and kept, once for each different pair of them.

    Of each component one pair is kept: of the smallest id (a null one only if there is no other), then of the smallest key.
    """
    rows, labels, n = labelled(docs, least)
    pairs = rows.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("rows"), F.first("node").alias("node"))
    pairs = cut(pairs.join(sent(labels.select("node", "root"), n), "node", "left"), "pairs")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("key").alias("key"))
    lead, n = counted(pairs.where("root is not null").groupBy("root").agg(F.min(order).alias("lead")), "leads")
    out = pairs.join(sent(lead, n), "root", "left")
    # without words there is no component, and nothing to be a copy of
    return out.select("doc_id", "key", "rows", (F.col("root").isNull() | order.eqNullSafe(F.col("lead"))).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"))


SQL = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach AS (SELECT doc_id AS a, doc_id AS b FROM words UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
least_id AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = w.doc_id AS kept
FROM words w LEFT JOIN sizes USING (doc_id) JOIN least_id ON least_id.a = w.doc_id"""
