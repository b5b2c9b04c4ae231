"""Byte-level BPE encoding and decoding by prefix dynamic programming.

The encoding of every byte prefix ends in exactly one token that can stand there: the token
whose predecessor is the last token of the remaining shorter prefix and that would not have
been merged across the boundary. One array of those last tokens therefore holds the encoding
of all prefixes. Appending bytes only adds entries, and an edit only changes the entries
between it and the point where the old entries hold again.

The rank file stays where it is; its path is a parameter. Its bytes (under 1 MB, a fixed
vocabulary, independent of the corpus) are broadcast, and each worker builds its tables once.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftgraph.llm.common import give_back, id_and_text

#: Entries a task keeps of encoded pieces, of prefixes and of judged token pairs before it starts
#: anew. Ids are kept packed and pairs as one number each, since two such tasks share an executor
#: with whatever earlier stages have left in it.
CACHE_ENTRIES = 150_000

#: Longer pieces seldom come again and are not kept.
CACHED_LENGTH = 64

#: Texts whose ids are held at a time.
SLICE = 500

#: Prefixes of so many bytes are kept across pieces.
SHARED_PREFIX = 6

#: White space as the Unicode property has it; the regex module's \s adds four control codes.
_SPACE = r"\t-\r \x85\xa0  -     　"


def piece_pattern(pattern: str) -> regex.Pattern:
    """The splitting pattern, with \\s and \\S spelled out as the White_Space property."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(_SPACE if inside else f"[{_SPACE}]")
            i += 2
        elif two == r"\S":
            out.append(f"[^{_SPACE}]")
            i += 2
        elif pattern[i] == "\\":
            out.append(two)
            i += 2
        else:
            inside = inside or pattern[i] == "["
            inside = inside and pattern[i] != "]"
            out.append(pattern[i])
            i += 1
    return regex.compile("".join(out))


class Vocabulary:
    """Tokens by rank, the two parts each merged token is made of, and which pairs can stand."""

    def __init__(self, rank_file: bytes):
        lines = (line.split() for line in rank_file.splitlines() if line.strip())
        self.rank: dict[bytes, int] = {base64.b64decode(a): int(b) for a, b in lines}
        #: Ids are below this; a pair of tokens is left * size + right.
        self.size = max(self.rank.values(), default=0) + 1
        self.token: list[bytes | None] = [None] * self.size
        for whole, new in self.rank.items():
            self.token[new] = whole
        self.longest = max(map(len, self.rank), default=1)
        #: The left and the right part of each token, -1 for those that no merge makes.
        self.left, self.right = [-1] * self.size, [-1] * self.size
        self.merged: dict[int, int] = {}
        self._stands: dict[int, bool] = {}
        for whole, new in sorted(self.rank.items(), key=lambda x: x[1]):
            for cut in range(1, len(whole)):
                left, right = self.rank.get(whole[:cut], new), self.rank.get(whole[cut:], new)
                if left < new and right < new and self._judge(left, right):
                    self.left[new], self.right[new] = left, right
                    self.merged[left * self.size + right] = new
                    break
        #: What the dynamic program may use: single bytes and tokens that merges can reach.
        self.usable = {b: i for b, i in self.rank.items() if len(b) == 1 or self.left[i] >= 0}
        if len(self.usable) == len(self.rank):
            self.usable = self.rank
        self.lengths = [len(b or b"") for b in self.token]
        #: Length of the longest usable token by its last three bytes; others have two at most.
        self.reach: dict[bytes, int] = {}
        for b in self.usable:
            if len(b) > 2:
                self.reach[b[-3:]] = max(self.reach.get(b[-3:], 2), len(b))

    def _judge(self, left: int, right: int) -> bool:
        """Can left and right be neighbours in a finished encoding?

        The merges that built both are undone, latest first. Whenever the two tokens beside
        the boundary would have merged before either was taken up on its own side, they
        cannot. Of equal merges the one further left comes first.
        """
        above_left = above_right = self.size
        while True:
            across = self.merged.get(left * self.size + right)
            if across is not None and across < above_left and across <= above_right:
                return False
            if left > right and self.right[left] >= 0:
                above_left, left = left, self.right[left]
            elif self.left[right] >= 0:
                above_right, right = right, self.left[right]
            elif self.right[left] >= 0:
                above_left, left = left, self.right[left]
            else:
                return True

    def stands(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self._stands.get(key)
        if known is None:
            if len(self._stands) >= CACHE_ENTRIES:
                self._stands.clear()
            known = self._stands[key] = self._judge(left, right)
        return known

    def last_token(self, data: bytes, end: int, last: list[int]) -> int:
        """The one token that can end data[:end], given those of all shorter prefixes."""
        usable, judged, size = self.usable, self._stands, self.size
        reach = self.reach.get(data[max(0, end - 3) : end], 2)
        for start in range(end - reach if end > reach else 0, end):
            token = usable.get(data[start:end])
            if token is None:
                continue
            if start == 0:
                return token
            known = judged.get(last[start - 1] * size + token)
            if known or known is None and self.stands(last[start - 1], token):
                return token
        raise ValueError("the vocabulary lacks a byte")

    def encode_piece(self, data: bytes, known: dict[bytes, tuple[int, ...]]) -> tuple[int, ...]:
        """Encoding of a piece; known keeps the last tokens of a prefix that pieces share."""
        usable, judged, reaches, size = self.usable.get, self._stands.get, self.reach.get, self.size
        last = list(known.get(data[:SHARED_PREFIX], ()))
        for end in range(len(last) + 1, len(data) + 1):
            reach = reaches(data[end - 3 : end], 2) if end > 2 else 2
            for start in range(end - reach if end > reach else 0, end):
                token = usable(data[start:end])
                if token is not None:
                    if start == 0:
                        break
                    fits = judged(last[start - 1] * size + token)
                    if fits or fits is None and self.stands(last[start - 1], token):
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
            last.append(token)
            if end == SHARED_PREFIX:
                known[data[:end]] = tuple(last)
        at, out, lengths = len(data), [], self.lengths
        while at:
            token = last[at - 1]
            out.append(token)
            at -= lengths[token]
        out.reverse()
        return tuple(out)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class PrefixTable:
    """last[i] is the last token of the encoding of the first i + 1 bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def _at(self, end: int) -> int:
        return self.vocabulary.last_token(self.data, end, self.last)

    def append(self, more: bytes) -> PrefixTable:
        begin = len(self.data)
        self.data += more
        for end in range(begin + 1, len(self.data) + 1):
            self.last.append(self._at(end))
        return self

    def replace(self, start: int, stop: int, new: bytes) -> PrefixTable:
        """Replace data[start:stop]; entries are computed until the old ones hold again.

        An entry follows from the bytes and entries of one longest token before it, so after
        that many equal entries in a row all later ones are equal too.
        """
        tail, shift = self.last[stop:], len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        del self.last[start:]
        equal, resume = 0, start + len(new)
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._at(end))
            if end > resume:
                equal = equal + 1 if self.last[-1] == tail[end - 1 - resume] else 0
                if equal >= self.vocabulary.longest:
                    self.last.extend(tail[end - resume :])
                    break
        assert len(self.last) == len(self.data), shift
        return self

    def ids(self, end: int | None = None) -> tuple[int, ...]:
        """Encoding of the first end bytes (of all, if None)."""
        at, out = len(self.data) if end is None else end, []
        while at:
            out.append(self.last[at - 1])
            at -= len(self.vocabulary.token[out[-1]])
        return tuple(reversed(out))


class _Pieces(dict):
    """Packed encodings of pieces already met: up to CACHE_ENTRIES, and as many from before that."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary, self.known, self.older = vocabulary, {}, {}
        self.kind = "H" if vocabulary.size <= 1 << 16 else "I"

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            data = piece.encode("utf-8")
            whole = self.vocabulary.rank.get(data)
            if len(self.known) >= CACHE_ENTRIES:
                self.known.clear()
            found = (whole,) if whole is not None else self.vocabulary.encode_piece(data, self.known)
            ids = array(self.kind, found).tobytes()
        if len(self) >= CACHE_ENTRIES:
            self.older = dict(self)
            self.clear()
        if len(piece) <= CACHED_LENGTH:
            self[piece] = ids
        return ids

    def forget(self) -> None:
        self.clear()
        self.known.clear()
        self.older.clear()


class Encoder:
    """Encodes and decodes texts; a piece of the splitting pattern is encoded by itself."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.vocabulary = Vocabulary(rank_file)
        self.split = piece_pattern(pattern).findall
        self.pieces = _Pieces(self.vocabulary)

    @cached_property
    def digits(self) -> list[str]:
        return [str(i) for i in range(self.vocabulary.size)]

    def packed(self, text: str) -> np.ndarray:
        """Ids of a text, in two bytes each if the vocabulary allows."""
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, self.split(text))), self.pieces.kind)

    def encode(self, text: str) -> list[int]:
        return self.packed(text).tolist()

    def decode(self, ids) -> bytes:
        return self.vocabulary.decode(ids)

    def forget(self) -> None:
        """Drop what was learned from texts; the vocabulary's tables stay."""
        self.pieces.forget()
        self.vocabulary._stands.clear()
        gc.collect()  # its lists of free objects keep whole arenas


_encoders: dict[str, Encoder] = {}


def _encoder(rank_file: bytes, pattern: str) -> Encoder:
    key = hashlib.sha256(rank_file + b"\0" + pattern.encode()).hexdigest()
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(rank_file, pattern)
    return _encoders[key]


def _each(docs: DataFrame, rank_path: str, pattern: str, schema: str, row) -> DataFrame:
    with open(rank_path, "rb") as f:  # the driver reads it; executors need no such file
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())
    arrow = docs.sparkSession.createDataFrame([], schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    fields = to_arrow_schema(arrow.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.collect()
        give_back()  # what earlier stages have left in this worker
        encoder = _encoder(ranks.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                rows = [(i, *row(encoder, t.as_py())) for i, t in zip(part.column(0).to_pylist(), part.column(1), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)
                pa.default_memory_pool().release_unused()
        encoder.forget()  # a worker lives on, and other operators need its memory
        give_back()

    return id_and_text(docs).mapInArrow(run, schema)


def _ids(encoder: Encoder, text: str) -> tuple:
    return (encoder.packed(text),)


def _digest(encoder: Encoder, text: str) -> tuple:
    ids = encoder.encode(text)
    joined = ",".join(map(encoder.digits.__getitem__, ids)).encode()
    return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()


def _round_trip(encoder: Encoder, text: str) -> tuple:
    ids = encoder.packed(text)
    return ids, encoder.decode(ids.tolist()).decode("utf-8") == text


def encode(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id and ids (array of int) of every whole text.

    A null or empty text has no ids. Equal rows give equal rows; order and ties play no part.
    Other columns of docs are ignored, and an empty table gives an empty result.
    """
    return _each(docs, rank_path, pattern, "doc_id long, ids array<int>", _ids)


def encode_checked(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """As encode, with exact: whether the decoded ids are the text again."""
    return _each(docs, rank_path, pattern, "doc_id long, ids array<int>, exact boolean", _round_trip)


def digests(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, SHA-256 of the comma-joined ids and of the bytes decoded from them.

    Cases as in encode; an empty text has 0 tokens and twice the digest of no bytes.
    """
    return _each(docs, rank_path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", _digest)
