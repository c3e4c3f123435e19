"""Byte-level BPE by way of a sentencepiece model that is written here from the vocabulary alone.

Every byte is mapped to one printable character, so each vocabulary entry becomes a sentencepiece piece; its score is
minus its rank, so that sentencepiece's best-scoring merge is the lowest-ranked one. Normalisation is the identity and
no prefix is added. The model is applied to each match of the split pattern separately; decoding maps ids to the model's
pieces and these, by the inverse of the map, back to bytes. A match that is itself an entry is that entry, whether or not merges lead to it.

Nulls are empty texts: no tokens and the hashes of empty strings. Rows are independent: repeated rows give repeated
results, an empty table an empty one; texts are read whole, one at a time, whatever their length; columns besides id and text are ignored (or kept by ``encode``).
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sagitta.llm.common import read

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Matches whose ids are kept in a worker, at most; then the store is emptied. It changes speed, not results.
KEPT_MATCHES = 200_000
KEPT_LENGTH = 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """For each byte, a character that no normaliser touches: itself where printable, else one from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protobuf field: bytes, a varint, or a float."""

    def varint(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        out.append(n)
        return bytes(out)

    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    return varint(number << 3) + varint(value)


def read_ranks(path: str) -> list[bytes]:
    """The entries in order of rank; ranks must be 0, 1, 2 ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(word)) for word, rank in pairs)
    if [r for r, _ in ranked] != list(range(len(ranked))):
        raise ValueError("ranks have gaps")
    return [word for _, word in ranked]


def serialise(entries: list[bytes]) -> bytes:
    """A sentencepiece model: the pieces in order of rank, then the unknown piece."""
    shown = byte_characters()
    pieces = [_field(1, _field(1, "".join(shown[b] for b in word).encode()) + _field(2, -float(rank))) for rank, word in enumerate(entries)]
    pieces.append(_field(1, _field(1, b"\xee\x80\x80") + _field(2, 0.0) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, len(entries))
    trainer += b"".join(_field(k, 2**64 - 1) for k in (41, 42, 43))
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece

        self.entries = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(serialise(self.entries))
        self.whole = {word: [rank] for rank, word in enumerate(self.entries)}
        self.split = regex.compile(pattern).findall
        self.shown = {b: ord(c) for b, c in enumerate(byte_characters())}
        self.bytes = {c: chr(b) for b, c in self.shown.items()}
        self.kept: dict[str, list[int]] = {}
        self.pieces: dict[int, bytes] = {}

    def _match(self, piece: str) -> list[int]:
        raw = piece.encode()
        if (ids := self.whole.get(raw)) is None:
            ids = self.model.EncodeAsIds(raw.decode("latin-1").translate(self.shown))
        if len(piece) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT_MATCHES:
                self.kept.clear()
            self.kept[piece] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        kept, add = self.kept, out.extend
        for piece in self.split(text):
            add(kept.get(piece) or self._match(piece))
        return out

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids: each one's piece in the model, its characters mapped back to bytes."""
        out, known = [], self.pieces
        for i in ids:
            if (raw := known.get(i)) is None:
                raw = known[i] = self.model.IdToPiece(i).translate(self.bytes).encode("latin-1")
            out.append(raw)
        return b"".join(out)


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec in each worker process."""
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(path, pattern)
    return _codecs[path, pattern]


def _pattern(pattern: str | None) -> str:
    import public_tokenizers

    return pattern or public_tokenizers.PATTERN


def encode(docs: DataFrame, text: str = "text", ids: str = "token_ids", vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """docs with a column ids: array<int> of the text's tokens (it replaces a column of that name)."""
    pattern = _pattern(pattern)

    @F.pandas_udf("array<int>")
    def tokens(texts):
        c = codec(vocabulary_path(vocabulary), pattern)
        return texts.map(lambda t: c.encode(t or ""))

    return docs.withColumn(ids, tokens(F.coalesce(F.col(text), F.lit(""))))


def decode(docs: DataFrame, ids: str = "token_ids", text: str = "text", vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """docs with a column text: the bytes of its tokens as UTF-8 (a null array: null)."""
    pattern = _pattern(pattern)

    @F.pandas_udf("string")
    def texts(arrays):
        c = codec(vocabulary_path(vocabulary), pattern)
        return arrays.map(lambda a: None if a is None else c.decode(list(a)).decode("utf-8", "replace"))

    return docs.withColumn(text, texts(F.col(ids)))


def digests(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str | None = None) -> DataFrame:
    """For each row: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the whole text's tokens."""
    pattern = _pattern(pattern)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary_path(vocabulary), pattern)
        shown = [str(i) for i in range(len(c.entries))]
        for batch in batches:
            n, a, b = [], [], []
            for value in batch.column(1):
                ids = c.encode(value.as_py() or "")
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(shown.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "documents"))
