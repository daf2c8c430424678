"""Byte-level BPE through a sentencepiece model that is written out from the ranks.

The model has no trained scores: a piece is a token's bytes, each byte mapped to one
printable character, and its score is the negative rank, so that sentencepiece merges in
the order of the ranks. Normalisation is the identity and nothing is added, so a match of
the split pattern is one sentence. Decoding looks the pieces up and maps them back.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from buildlens.llm.common import per_task, record_batch, slices, table
from buildlens.llm.tokens import WordEncoder, byte_characters

NORMAL, UNKNOWN, BPE = 1, 2, 2
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
    ("decoded_sha256", pa.string()), ("same", pa.bool_()),
])


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes(out) + bytes([n])


def _field(number: int, value: int | float | bytes) -> bytes:
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value & (1 << 64) - 1)


def serialise_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model: the unknown piece, then the tokens in the order of their ranks.

    Piece ``i + 1`` is the i-th token; ranks may have gaps, scores keep their order.
    """
    chars = byte_characters()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, UNKNOWN)]
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        name = "".join(chars[b] for b in token).encode()
        pieces.append(_field(1, name) + _field(2, float(-rank)) + _field(3, NORMAL))
    trainer = _field(3, BPE) + _field(40, 0) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + b"".join(_field(n, 0) for n in (3, 4, 5))
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes with one serialised model."""

    def __init__(self, model: bytes, ranks: dict[bytes, int], pattern: str):
        import regex
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        tokens = sorted(ranks, key=ranks.get)
        self.ranks = [0, *(ranks[t] for t in tokens)]
        self.map = str.maketrans({i: c for i, c in enumerate(byte_characters())})
        back = {c: i for i, c in enumerate(byte_characters())}
        self.bytes = {
            ranks[t]: bytes(back[c] for c in self.model.id_to_piece(i + 1))
            for i, t in enumerate(tokens)
        }
        # Tokens that merging does not reach still stand for themselves as a whole match.
        found = self.model.encode([self.mapped(t) for t in tokens], num_threads=1)
        self.whole = {
            self.mapped(t): ranks[t] for i, (t, f) in enumerate(zip(tokens, found)) if f != [i + 1]
        }
        self.words = WordEncoder(regex.compile(pattern).findall, self._encode)

    def mapped(self, piece: bytes) -> str:
        return piece.decode("latin-1").translate(self.map)

    def _encode(self, pieces: list[str]) -> list[bytes]:
        mapped = [self.mapped(p.encode()) for p in pieces]
        found = self.model.encode(mapped, num_threads=1) if mapped else []
        rank = self.ranks
        out = [array("I", [rank[i] for i in f]).tobytes() for f in found]
        if self.whole:
            for i, p in enumerate(mapped):
                if p in self.whole:
                    out[i] = array("I", [self.whole[p]]).tobytes()
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes.__getitem__, array("I", ids)))


def codec(model: bytes, ranks: dict[bytes, int], pattern: str) -> Codec:
    key = ("sentencepiece", hashlib.sha256(model).digest(), pattern)
    return per_task(key, lambda: Codec(model, ranks, pattern))


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256, same`` for every row of ``docs``.

    A null text is empty and has no ids; both digests are then those of no bytes. A null
    ``doc_id`` stays null, repeated rows give repeated results, other columns are left out.
    ``same`` tells whether decoding gave back the bytes of the text.
    """
    model = serialise_model(ranks)
    sent = docs.sparkSession.sparkContext.broadcast((model, ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for part in slices(batches):
            own = own or codec(*sent.value, pattern)
            flat, ends = own.words.many(part.column(1))
            n, ids_hash, decoded_hash, same = [], [], [], []
            at = 0
            for text, end in zip(part.column(1).to_pylist(), ends.tolist()):
                ids, at = flat[at:end].tobytes(), end
                decoded = own.decode(ids)
                n.append(len(ids) // 4)
                ids_hash.append(hashlib.sha256(ids).hexdigest())
                decoded_hash.append(hashlib.sha256(decoded).hexdigest())
                same.append(decoded == (text or "").encode())
            yield record_batch(SCHEMA, [part.column(0), n, ids_hash, decoded_hash, same])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, same boolean")


def op10_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode_documents(table(spark, folder, "documents"), ranks, public_tokenizers.PATTERN)
