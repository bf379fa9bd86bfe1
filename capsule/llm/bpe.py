"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text exactly one token can be the last one of the prefix's encoding. A state therefore
keeps one token per prefix: the token t that ends there and, unless it covers the whole prefix, may follow the last
token of the prefix before it. A token may follow another if encoding the two together leaves both whole. Following the
last tokens backwards gives the encoding. More bytes extend the states; an edit redoes only states near it.

`encode` runs this inside tasks over whole texts, each match of the split pattern on its own. Pieces that recur are
looked up in a table that is emptied when it is full, so memory stays bounded. The rank file is read once on the driver
and broadcast (its size is fixed by the vocabulary).

Defined cases. Null or empty text: no tokens, empty ids. Very long texts and pieces: linear time, one document at a
time. Repeated rows: each gives a row. Empty table: empty result. Columns of the input stay; input columns named like an
added one are replaced by it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from capsule.llm.common import table

#: Entries of the table of encoded pieces in one Python worker, about 200 bytes each. The worker holds them beyond its task, also
#: while it works on other stages.
KEPT_PIECES = 250_000
#: Pieces up to this length have only the states that their encoding needs.
LAZY_BYTES = 64
NEVER = 1 << 40


class Vocabulary:
    """Tokens by rank; what may stand next to what."""

    def __init__(self, ranks: bytes):
        self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.bytes = [b""] * (max(self.ids.values(), default=-1) + 1)
        for token, rank in self.ids.items():
            self.bytes[rank] = token
        self.longest = max(map(len, self.ids), default=1)
        # every ending of a token, with its rank if it is a token itself
        self.endings = {t[i:]: -1 for t in self.ids for i in range(len(t))} | self.ids
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._spines: dict[tuple[int, bool], list[int]] = {}
        self._may_follow: dict[int, bool] = {}

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of `token` joins; None for a single byte."""
        if token not in self._halves:
            parts = [self.bytes[token][i:i + 1] for i in range(len(self.bytes[token]))]
            while len(parts) > 2:
                rank, at = min((self.ids.get(a + b, NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank >= token:
                    raise ValueError(f"token {token} is not made by merges of lower rank")
                parts[at:at + 2] = [parts[at] + parts[at + 1]]
            self._halves[token] = (self.ids[parts[0]], self.ids[parts[1]]) if len(parts) == 2 else None
        return self._halves[token]

    def spine(self, token: int, right: bool) -> list[int]:
        """The tokens at the right (or left) edge of `token` as it is merged, from the byte to the whole."""
        if (token, right) not in self._spines:
            up, half = [token], self.halves(token)
            while half:
                up.append(half[right])
                half = self.halves(half[right])
            self._spines[token, right] = up[::-1]
        return self._spines[token, right]

    def may_follow(self, first: int, second: int) -> bool:
        """Whether encoding both together gives just these two.

        Merges happen in the order of rank. As they do, the edges of both tokens grow along their spines; the pair
        breaks if at some time the two tokens that meet there would be merged before either is merged into its own.
        Of equal ranks the left one goes first.
        """
        key = first << 32 | second
        known = self._may_follow.get(key)
        if known is None:
            known = self._may_follow[key] = self._follows(self.spine(first, True), self.spine(second, False))
        return known

    def _follows(self, left: list[int], right: list[int]) -> bool:
        i = j = 0
        while True:
            joined = self.ids.get(self.bytes[left[i]] + self.bytes[right[j]], NEVER)
            next_left = left[i + 1] if i + 1 < len(left) else NEVER
            next_right = right[j + 1] if j + 1 < len(right) else NEVER
            if joined < next_left and joined <= next_right:
                return False
            if next_left == next_right == NEVER:
                return True
            if next_left <= next_right:
                i += 1
            else:
                j += 1


    def last_token(self, piece: bytes, end: int, states: dict[int, int] | list[int]) -> int:
        """Last token of the prefix of `end` bytes; `states` holds those known (of shorter prefixes, -1: not yet) and
        receives those found on the way."""
        endings, start, found = self.endings, end - 1, []
        while start >= 0:
            token = endings.get(piece[start:end])
            if token is None:
                break
            if token >= 0:
                found.append(token)
            start -= 1
        while found:
            token = found.pop()  # the longest first
            start = end - len(self.bytes[token])
            if not start:
                break
            before = states[start]
            if before < 0:
                before = self.last_token(piece, start, states)
            ok = self._may_follow.get(before << 32 | token)
            if ok is None:
                ok = self.may_follow(before, token)
            if ok:
                break
        else:
            raise ValueError("the vocabulary lacks a byte")
        states[end] = token
        return token

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of a piece. In a short one, only the states on the way back from its end are found."""
        if len(piece) > LAZY_BYTES:
            return Prefixes(self, piece).tokens()
        states, out, end = [-1] * (len(piece) + 1), [], len(piece)
        self.last_token(piece, end, states)
        while end:
            out.append(states[end])
            end -= len(self.bytes[states[end]])
        return out[::-1]


class Prefixes:
    """A growing piece of bytes with the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        start, self.piece = len(self.piece), self.piece + more
        self.last += [-1] * len(more)
        for end in range(start + 1, len(self.piece) + 1):
            self.vocabulary.last_token(self.piece, end, self.last)

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put `new` in place of piece[start:stop]; the number of states that had to be found again."""
        old, tail = self.last, len(self.piece) - stop
        self.piece = self.piece[:start] + new + self.piece[stop:]
        self.last = old[:start + 1] + [-1] * (len(new) + tail)
        same = 0
        for end in range(start + 1, len(self.piece) + 1):
            self.vocabulary.last_token(self.piece, end, self.last)
            before = end - len(self.piece) + len(old) - 1
            same = same + 1 if end - start - len(new) > 0 and old[before] == self.last[end] else 0
            if same >= self.vocabulary.longest:  # what follows depends on these states alone
                self.last[end + 1:] = old[before + 1:]
                return end - start
        return len(self.piece) - start

    def tokens(self) -> list[int]:
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end])
            end -= len(self.vocabulary.bytes[self.last[end]])
        return out[::-1]


class Encoder(dict):
    """Encodes texts; as a dict, the packed ids of pieces met so far."""

    def __init__(self, ranks: bytes, pattern: str):
        import regex
        super().__init__()
        # the white space of Unicode, which other engines write \s
        self.pieces = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.vocabulary = Vocabulary(ranks)

    def __missing__(self, piece: str) -> bytes:
        raw = piece.encode()
        whole = self.vocabulary.ids.get(raw)  # a token that is a whole prefix needs no earlier state
        ids = [whole] if whole is not None else self.vocabulary.encode(raw)
        packed = self[piece] = b"".join(i.to_bytes(4, "little") for i in ids)
        return packed

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if len(self) > KEPT_PIECES:
            self.clear()
        if len(self.vocabulary._may_follow) > KEPT_PIECES:
            self.vocabulary._may_follow.clear()
        return b"".join(map(self.__getitem__, self.pieces(text))) if text else b""

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, memoryview(packed).cast("I").tolist())) if packed else b""


_encoders: dict[tuple[str, str], Encoder] = {}


def _encoder(ranks, pattern: str) -> Encoder:
    """One encoder for each worker and vocabulary; `ranks` is a broadcast value."""
    key = (hashlib.sha256(ranks.value).hexdigest(), pattern)
    if key not in _encoders:
        _encoders[key] = Encoder(ranks.value, pattern)
    return _encoders[key]


def _map(docs: DataFrame, column: str, new: list[StructField], ranks: bytes, pattern: str, make) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(ranks)
    kept = docs.drop(*(f.name for f in new if f.name != column))
    schema = StructType([*kept.schema.fields, *new])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                arrays = make(encoder, part.column(part.schema.get_field_index(column)))
                yield pa.RecordBatch.from_arrays([*part.columns, *arrays], names=schema.fieldNames())
    return kept.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """`docs` (column text and any others) with n_tokens and ids (array<int>)."""
    def make(encoder: Encoder, texts: pa.Array) -> list[pa.Array]:
        packed = [encoder.encode(t.as_py()) for t in texts]
        sizes = [len(p) // 4 for p in packed]
        offsets = pa.array([0, *sizes], pa.int64()).to_numpy().cumsum()
        flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(packed))])
        return [pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat)]
    new = [StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType()))]
    return _map(docs, "text", new, ranks, pattern, make)


def decode(tokens: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """`tokens` (column ids and any others) with decoded, the text; bytes that are no UTF-8 become U+FFFD."""
    def make(encoder: Encoder, ids: pa.Array) -> list[pa.Array]:
        return [pa.array([b"".join(encoder.vocabulary.bytes[i] for i in x.as_py() or ()).decode("utf-8", "replace") for x in ids], pa.string())]
    return _map(tokens, "ids", [StructField("decoded", StringType())], ranks, pattern, make)


def digests(docs: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """`docs` with n_tokens, ids_sha256 and decoded_sha256: encoding and decoding in one pass, nothing large leaves."""
    def make(encoder: Encoder, texts: pa.Array) -> list[pa.Array]:
        rows = []
        for t in texts:
            packed = encoder.encode(t.as_py())
            rows.append((len(packed) // 4, hashlib.sha256(packed).hexdigest(),
                         hashlib.sha256(encoder.decode(packed)).hexdigest()))
        return [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
    new = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()),
           StructField("decoded_sha256", StringType())]
    return _map(docs, "text", new, ranks, pattern, make)


def vocabulary_file(path: str | None = None) -> tuple[bytes, str]:
    """Content of a rank file and the pattern that goes with it."""
    import public_tokenizers
    return Path(path or public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN


def op7_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Every text encoded and decoded."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text"))
    return digests(docs, *vocabulary_file(path)).drop("text")
