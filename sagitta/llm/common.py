"""What the text operators share: reading tables, cutting lineage and splitting UTF-8 buffers into words.

The numpy half works on raw UTF-8 buffers, a block of about a quarter of a megabyte at a time, so a worker's memory is bounded
by its largest single text, not by the batch that Arrow happens to send.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sagitta.sources import files
from sagitta.sources.files import done  # noqa: F401

#: The bytes that separate words: space and tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
GAP_PATTERN = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 18
MIX_A, MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

IS_WORD = np.ones(256, bool)
IS_WORD[[32, *range(9, 14)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


#: Bytes of rows that Arrow sends to a Python worker at a time, about; one row may have more.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Limits Arrow batches by bytes, so that long texts don't add up, unless the session has a limit of its own."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.conf.get(name, None):
        spark.conf.set(name, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the folder. The session's Arrow batches are bounded from here on, as every operator that needs it reads here."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again."""
    bound_batches(df.sparkSession)
    return files.cut(df, name)


def counted(df: DataFrame, name: str, *sums: Column) -> tuple:
    """As cut, with the number of rows and other aggregates, which the writing itself takes."""
    bound_batches(df.sparkSession)
    return files.counted(df, name, *sums)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns of a step's own, which no column of df has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def let(value: Column, body) -> Column:
    """body(value), with value computed once: Catalyst would copy a plain column into every place that names it."""
    return F.transform(F.array(value), body)[0]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * MIX_A
    x ^= x >> np.uint64(27)
    x = x * MIX_B
    x ^= x >> np.uint64(31)
    return x


BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = np.uint64(0x2545F4914F6CDD1D | 3)
_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        p = np.full(max(n, 64), STEP, np.uint64)
        p[0] = 1
        _powers = np.cumprod(p)
    return _powers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a column, and where each begins (one more for the end). A null is an empty text."""
    column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def blocks(data: np.ndarray, offs: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about size bytes: first row, end row, their bytes, their offsets."""
    n, a = len(offs) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b


def word_spans(data: np.ndarray, offs: np.ndarray, is_word: np.ndarray = IS_WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each text the place of its first word (one more for the end)."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = is_word[data]
    breaks = offs[1:-1]
    starts = inside[:-1].copy()
    starts[1:] &= ~inside[:-2]
    at = breaks[breaks < len(data)]
    starts[at] = inside[at]
    ends = inside[:-1] & ~inside[1:]
    at = breaks[breaks > 0] - 1
    ends[at] = inside[at]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offs)


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes."""
    if not len(s):
        return np.zeros(0, np.uint64)
    size = e - s
    ends = np.cumsum(size)
    begin = ends - size
    place = np.arange(ends[-1]) - np.repeat(begin, size)
    codes = BYTE_CODES[data[place + np.repeat(s, size)]] * powers(int(size.max()))[place]
    return mixed(np.add.reduceat(codes, begin) + size.astype(np.uint64))


def shingle_hashes(words: np.ndarray, first: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word runs, in order and with repeats, and each text's place among them.

    A text of fewer words, if it has any, gives its whole sequence as one.
    """
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    place = np.concatenate([[0], np.cumsum(made)])
    if not place[-1]:
        return np.zeros(0, np.uint64), place
    start = np.arange(place[-1]) - np.repeat(place[:-1], made) + np.repeat(first[:-1], made)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    length = np.repeat(np.minimum(count, n), made)
    out = length.astype(np.uint64)
    for k in range(n):
        out = mixed(out * STEP + np.where(length > k, padded[start + k], np.uint64(0)))
    return out, place


#: Tasks that a group's sample is dealt to.
SALTS = 16


def bounded_sample(rows: DataFrame, n: int, by: str | None = None, groups: int = 1000, text: str = "text") -> DataFrame:
    """At most about n rows of each value of ``by``, and of at most ``groups`` values, the most frequent: the same rows on every run.

    Groups of up to n rows come whole. Of others a share by a hash of id and text is taken, half as many again as are wanted, and of that
    the least hashes in each of SALTS parts stay, so repeated ids or rows do not add up and no task has all of a group.
    """
    part, salt, rank, group = fresh(rows, "part", "salt", "rank", "group")
    rows = rows.withColumn(part, F.pmod(F.xxhash64(F.lit("sample"), "doc_id", text), F.lit(1 << 30)) / float(1 << 30))
    rows = rows.withColumn(group, F.col(by) if by else F.lit(0))
    counts = rows.groupBy(group).count().orderBy(F.desc("count"), group).limit(groups).collect()
    if not counts:
        return rows.drop(part, group)
    shares = F.create_map(*(x for value, count in counts for x in (F.lit(value), F.lit(1.5 * n / count + 50 / count if count > n else 2.0))))
    share = F.coalesce(shares[F.col(group)], F.lit(0.0))
    small = rows.where(share == 2.0).drop(part, group)
    if all(count <= n for _, count in counts):
        return small
    near = rows.where((share < 2.0) & (F.col(part) < share)).withColumn(salt, F.pmod(F.xxhash64(F.lit("salt"), "doc_id", text), F.lit(SALTS)))
    least = F.row_number().over(Window.partitionBy(group, salt).orderBy(part, "doc_id"))
    kept = near.withColumn(rank, least).where(F.col(rank) <= max(1, n // SALTS)).drop(part, salt, rank, group)
    return kept if all(count > n for _, count in counts) else small.unionByName(kept)


#: Training sees all of a text of up to as many characters; of a longer one as many windows, spread over it.
WHOLE_CHARS, WINDOWS, WINDOW_CHARS = 8000, 5, 1600


def excerpt(text: Column) -> Column:
    """A bounded stand-in for a text in a training sample: the text, or windows at even distances from start to end, a line each."""
    n = F.length(text)
    step = (n - WINDOW_CHARS) / float(WINDOWS - 1)
    windows = [F.substr(text, (F.floor(step * k) + 1).cast("int"), F.lit(WINDOW_CHARS)) for k in range(WINDOWS)]
    return F.when(n <= WHOLE_CHARS, text).otherwise(F.concat_ws("\n", *windows))


def has_letter(column: pa.Array) -> np.ndarray:
    return np.asarray(pc.fill_null(pc.match_substring_regex(column, r"\pL"), False))
