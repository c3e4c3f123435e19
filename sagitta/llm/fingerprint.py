"""Document fingerprints by one-permutation MinHash, in DataFrame operations alone.

A text's 5-word shingles (lower case) are hashed once. The hash's order is the permutation: its top bits are the bin, and
each bin keeps its least hash. An empty bin borrows from a full one that it finds by trying bins in a hashed
order of its own (optimal densification), so bins of different documents that borrow agree as often as the sets do. Of each
bin's hash, rehashed with the bin's number so that borrowed ones do not agree by chance together, the low ``BITS`` bits are
stored, one hexadecimal digit a bin; equal digits by chance are taken out of the
likeness, which estimates the Jaccard similarity of the shingle sets (standard error about 0.03 at 0.5).

A text of fewer words than a shingle has its whole sequence as its one shingle. Null and empty texts have the empty
fingerprint, which is like itself (1) and like no other (0). Extra columns are left alone. ``neighbours`` orders rows by
id with null ids first and equal ids by a hash of their texts; a table of one row is its own neighbour. Texts are read whole,
also very long ones; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagitta.llm.common import GAP_PATTERN, fresh, let, read

WORDS = 5
BINS = 256
BITS = 4
TRIES = 8
#: Rows of one range of ids, about; and ranges at most (each range is one sort, which may spill).
RANGE_ROWS = 1000
RANGES = 65_536
STEP = 256
FIRST = -(2**63)


def shingles(text: Column, n: int = WORDS) -> Column:
    """The hashes of a text's n-word runs."""
    trimmed = F.btrim(F.lower(text), F.lit(" \t\n\x0b\f\r"))
    words = F.transform(F.split(trimmed, GAP_PATTERN), lambda w: F.xxhash64(w))
    runs = let(words, lambda h: F.slice(F.transform(h, lambda x, i: F.xxhash64(x, *(F.get(h, i + k) for k in range(1, n)))), F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(1))))
    return F.when(trimmed == "", F.array().cast("array<bigint>")).otherwise(runs)


def bin_of(x: Column) -> Column:
    """0 to BINS - 1, ascending with the hash."""
    shift = 64 - (BINS - 1).bit_length()
    return (F.shiftright(x, shift) + BINS // 2).cast("int")


def densified(hashes: Column) -> Column:
    """BINS hashes: the least of each bin, an empty bin's borrowed. Null if there are no hashes."""
    least = let(F.sort_array(hashes), lambda s: F.filter(s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))
    gap = lambda n: F.array_repeat(F.lit(None).cast("long"), n)

    def spread(m: Column) -> Column:
        following = lambda i: F.coalesce(bin_of(F.get(m, i + 1)), F.lit(BINS))
        filled = F.flatten(F.transform(m, lambda x, i: F.concat(F.array(x), gap(following(i) - bin_of(x) - 1))))
        return let(F.concat(gap(bin_of(m[0])), filled), lambda v: borrowed(v, m))

    def borrowed(v: Column, m: Column) -> Column:
        tries = lambda i: [F.get(v, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("int")) for t in range(TRIES)]
        # after some tries: the full bin that comes first in the empty one's own hashed order of all bins
        rest = lambda i: F.array_min(F.transform(m, lambda x: F.struct(F.xxhash64(i, bin_of(x), F.lit("rest")).alias("at"), x.alias("x"))))["x"]
        return F.transform(v, lambda x, i: F.coalesce(x, *tries(i), rest(i)))

    return let(least, lambda m: F.when(F.size(m) > 0, spread(m)))


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text: BINS hexadecimal digits, or an empty string for a text without words."""
    digits = F.transform(densified(shingles(F.coalesce(text, F.lit("")))), lambda x, i: F.hex(F.xxhash64(x, i).bitwiseAND(F.lit(2**BITS - 1))))
    return F.coalesce(F.array_join(digits, ""), F.lit(""))


def likeness(a: Column, b: Column) -> Column:
    """The estimated similarity of two fingerprints, 0 to 1, less what digits agree by chance."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda t: t))
    chance = 2.0**-BITS
    estimate = (same / BINS - chance) / (1 - chance)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))


def ranges(docs: DataFrame, key: Column, tie: Column, rows: int = RANGE_ROWS) -> list[tuple[int, int]]:
    """Lower bounds (key, tie) of ranges of about equal numbers of rows, in order. The tie is FIRST for a key of one range.

    The bounds are quantiles of the keys. A key that is several of them, as many rows have it, is cut by its rows' ties: its
    bounds are the least ties of its parts.
    """
    n, least = docs.agg(F.count(F.lit(1)), F.min(key)).first()
    if not n:
        return []
    k = min(RANGES, -(-n // rows))
    marks = [i / k for i in range(1, k)]
    found = docs.agg(F.percentile_approx(key, F.array(*map(F.lit, marks)), F.lit(max(10_000, 4 * k)))).first()[0] if marks else []
    times = Counter([least, *found])
    hot = {x: c for x, c in times.items() if c > 1}
    bounds = [(x, FIRST) for x in times if x not in hot]
    if hot:
        parts = F.create_map(*(F.lit(x).cast("long") for pair in hot.items() for x in pair))
        cuts = docs.select(key.alias("key"), tie.alias("tie")).where(parts[F.col("key")].isNotNull())
        cuts = cuts.groupBy("key", F.floor((F.col("tie") / 2.0**64 + 0.5) * parts[F.col("key")]).alias("part")).agg(F.min("tie").alias("tie"))
        bounds += [(r.key, r.tie) for r in cuts.collect()]
    return sorted(bounds)


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of the last bound that is not over key: first among every STEP-th bound, then among the ones between."""
    literal = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    count = lambda xs, k: F.size(F.filter(xs, lambda b: b <= k))
    if len(bounds) <= STEP:
        return let(key, lambda k: count(literal(bounds), k) - 1)
    coarse, every = literal(bounds[::STEP]), literal(bounds)
    return let(key, lambda k: let(count(coarse, k) - 1, lambda c: c * STEP + count(F.slice(every, c * STEP + 1, F.lit(STEP)), k) - 1))


def neighbours(docs: DataFrame, carried: dict[str, Column], text: str = "text") -> DataFrame:
    """docs with a column next_<name> for each of carried, that column of the next row by doc_id (the last: of the first).

    Rows are dealt by ranges of ids, and of texts' hashes where many rows share an id; the first row of each range also goes, as a
    guest, to the end of the range before.
    """
    names = fresh(docs, "key", "tie", "range", "place", "at", "guest", *(f"own_{n}" for n in carried))
    key, tie, range_, place, at, guest, *own = names
    id_, hash_ = F.coalesce(F.col("doc_id"), F.lit(FIRST).cast("long")), F.xxhash64(text)
    bounds = ranges(docs, id_, hash_) or [(0, FIRST)]
    keys = sorted({k for k, _ in bounds})
    starts = [bisect.bisect_left(bounds, (k, FIRST)) for k in keys]
    cuts = {i: [t for _, t in bounds[a:b]] for i, (a, b) in enumerate(zip(starts, [*starts[1:], len(bounds)], strict=True)) if bounds[a][1] != FIRST}
    long = lambda xs: F.array(*(F.lit(x).cast("long") for x in xs))
    rows = docs.withColumns({key: id_, tie: hash_, **dict(zip(own, carried.values(), strict=True))})
    rows = rows.withColumn(range_, range_of(F.col(key), keys))
    opens, number = F.col(key) == F.get(long(keys), F.col(range_)), F.col(range_)
    if cuts:
        # a row of an id that is cut goes by its tie; the later ids of its range go to the last part
        ties = F.create_map(*(x for i, ts in cuts.items() for x in (F.lit(i), long(ts))))[F.col(range_)]
        part = F.when(ties.isNull(), 0).when(opens, F.size(F.filter(ties, lambda t: t <= F.col(tie))) - 1).otherwise(F.size(ties) - 1)
        number = F.get(long(starts), F.col(range_)).cast("int") + part
        opens = opens & (ties.isNull() | (F.get(ties, part) == F.col(tie)))
    here = F.struct(number.alias("at"), F.lit(0).alias("guest"))
    there = F.struct(F.pmod(number - 1, F.lit(len(bounds))).alias("at"), F.lit(1).alias("guest"))
    dealt = rows.withColumn(place, F.explode(F.when(opens, F.array(here, there)).otherwise(F.array(here)))).withColumns({at: F.col(f"{place}.at"), guest: F.col(f"{place}.guest")})
    along = Window.partitionBy(at).orderBy(guest, key, tie)
    out = dealt.withColumns({f"next_{n}": F.lead(o).over(along) for n, o in zip(carried, own, strict=True)}).where(F.col(guest) == 0)
    return out.select(*docs.columns, *(F.col(o).alias(n) for n, o in zip(carried, own, strict=True) if n not in docs.columns), *(f"next_{n}" for n in carried))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = neighbours(docs, {"text": F.col("text"), "fingerprint": fingerprint(F.col("text"))})
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - half), F.substr("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited).withColumn("edited_fingerprint", fingerprint(F.col("edited")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
