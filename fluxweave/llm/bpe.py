"""Byte-level BPE encoding and decoding in linear time.

The vocabulary goes into an Aho-Corasick automaton over bytes mapped to Latin-1. Each pre-token is covered from left
to right by the longest match that is compatible with the token before it; where none is, the next shorter one is
tried, and where none is left the search steps back. Two tokens are compatible exactly if merging their joined bytes
gives these two again, and a sequence of pairwise compatible tokens is the sequence that the merges give.
Compatibility is memoised, as are whole chunks of text, of which each distinct one is looked up once for many texts.

Null and empty texts give no tokens, an empty table gives no rows. Repeated rows give repeated rows. Texts are never cut,
however long. Other columns of the table are not looked at, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from fluxweave.llm.chunks import MARKS, gathered_ids, odd_texts, places
from fluxweave.llm.common import per_batch

#: Entries after which a memo table starts afresh; bounds memory, not results.
MEMO = 250_000
#: Fixed value: the pattern by which letters after a blank are one piece, and a mark after them is one.
PLAIN_WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encoder and decoder for one vocabulary of ranks and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        self.matcher = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
            self.matcher.add_word(token.decode("latin-1"), rank)
        self.latin = {token.decode("latin-1"): rank for token, rank in ranks.items()}
        self.widest = max(map(len, ranks))
        self.matcher.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.edges: dict[int, dict[int, list[tuple[str, int, int]]]] = {0: {}, -1: {}}
        codec = self

        class Spaced(dict):  # of what follows a blank, up to the next
            def __missing__(self, chunk: str) -> bytes:
                if len(self) > MEMO:
                    self.clear()
                found = b"".join([codec.pieces[p] for p in codec.pattern.findall(" " + chunk)])
                if len(chunk) <= 64:
                    self[chunk] = found
                return found

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) > MEMO:
                    self.clear()
                found = array("I", codec.encode_piece(piece.encode("utf-8", "surrogatepass"))).tobytes()
                if len(piece) <= 64:
                    self[piece] = found
                return found

        class Words(dict):  # letters after a blank, as one piece
            def __missing__(self, word: str) -> bytes:
                if len(self) > MEMO:
                    self.clear()
                found = array("I", codec.encode_piece(f" {word}".encode())).tobytes()
                if len(word) <= 64:
                    self[word] = found
                return found

        self.spaced, self.pieces, self.words = Spaced(), Pieces(), Words()
        plain = pattern == PLAIN_WORDS and all(m.encode() in ranks for m in MARKS)
        self.marks = [array("I", [ranks[m.encode()]]).tobytes() for m in MARKS] if plain else None
        self.sizes = np.array([len(b) for b in self.bytes_of], dtype=np.int64)
        self.blob = np.frombuffer(b"".join(self.bytes_of), np.uint8)

    def merge(self, text: str) -> list[str]:
        """Plain merging of Latin-1 text, lowest rank first; a whole token is left in its two last parts."""
        parts, rank, whole = list(text), self.latin.get, len(text)
        while len(parts) > 2 or len(parts) == 2 and len(parts[0]) + len(parts[1]) != whole:
            best, at = 1 << 60, -1
            for i in range(len(parts) - 1):
                r = rank(parts[i] + parts[i + 1])
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def edge(self, token: int, side: int) -> list[tuple[str, int, int]]:
        """The parts that stand at one side of a token while it is merged: (text, rank made at, rank merged at)."""
        edges = self.edges[side]
        if token not in edges:
            text, until, found = self.bytes_of[token].decode("latin-1"), 1 << 60, []
            while True:
                made = self.latin[text] if len(text) > 1 else -1
                found.append((text, made, until))
                if len(text) == 1:
                    break
                text, until = self.merge(text)[side], made
            edges[token] = found
        return edges[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the merges of the joined bytes never cross the place where the two tokens meet."""
        rank, known = self.latin.get, True
        for x, x_made, x_until in self.edge(left, -1):
            for y, y_made, y_until in self.edge(right, 0):
                r = rank(x + y)
                if r is not None and r < x_until and r <= y_until and x_made < y_until and y_made < x_until:
                    known = False
        if len(self.compatible) > MEMO:
            self.compatible.clear()
        self.compatible[(left << 32) | right] = known
        return known

    def encode_piece(self, data: bytes) -> list[int]:
        text = data.decode("latin-1")
        latin, end = self.latin, len(text)
        whole = latin.get(text)
        if whole is not None:
            return [whole]
        prefix, widest, compatible = self.matcher.longest_prefix, self.widest, self.compatible
        ids: list[int] = []
        sizes: list[int] = []
        dead: set[int] = set()  # places from which no valid cover goes on
        at, last, size = 0, -1, prefix(text[:widest])
        while at < end:
            while size:
                token = latin.get(text[at : at + size])
                if token is not None and at + size not in dead:
                    if last < 0:
                        break
                    known = compatible.get((last << 32) | token)
                    if known or known is None and self.fits(last, token):
                        break
                size -= 1
            if size:
                ids.append(token)
                sizes.append(size)
                last, at = token, at + size
                size = prefix(text[at : at + widest])
            elif ids:
                dead.add(at)
                ids.pop()
                at -= sizes[-1]
                size = sizes.pop() - 1
                last = ids[-1] if ids else -1
            else:
                raise ValueError("the vocabulary lacks a byte of this text")
        return ids

    def plain(self, text: str) -> bytes:
        return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))

    def encode_many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of texts without nulls, one after the other."""
        return gathered_ids(texts, odd_texts(texts), self.plain, self.plain, self.spaced.__getitem__, self.words.__getitem__ if self.marks else None, self.marks)

    def decode_many(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text."""
        raw = self.blob[places(self.sizes, ids)].tobytes()
        ends = np.concatenate([[0], np.cumsum(self.sizes[ids])])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode_bytes(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_many(pa.array([text or ""]))[0].astype("<u4").tobytes()

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.encode_bytes(text)).tolist()

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary file and Python worker."""
    key = (path, pattern)
    if key not in _CODECS:
        _CODECS[key] = Codec(load_ranks(path), pattern)
    return _CODECS[key]


def _texts(column: pa.Array) -> pa.Array:
    return pc.fill_null(column, "")


def _split(ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
    raw = ids.astype("<u4", copy=False).tobytes()
    ends = [0, *(4 * np.cumsum(counts)).tolist()]
    return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids binary): each text's ids as little-endian unsigned 32-bit integers."""

    def convert(batch):
        return {"id": batch.column(0), "ids": _split(*codec(path, pattern).encode_many(_texts(batch.column(1))))}

    out = per_batch(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")), convert, "id long, ids binary")
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, text_bytes binary): the bytes that the ids stand for."""

    def convert(batch):
        c = codec(path, pattern)
        return {"id": batch.column(0), "text_bytes": [c.decode(array("I", b or b"")) for b in batch.column(1).to_pylist()]}

    out = per_batch(encoded.select(encoded[id_col].alias("id"), encoded[ids_col].alias("ids")), convert, "id long, text_bytes binary")
    return out.withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, ids_sha256, decoded_sha256) in one pass: encode, decode the ids, digest both."""

    def convert(batch):
        c = codec(path, pattern)
        ids, counts = c.encode_many(_texts(batch.column(1)))
        digest = lambda parts: [hashlib.sha256(p).hexdigest() for p in parts]
        return {"id": batch.column(0), "n_tokens": counts, "ids_sha256": digest(_split(ids, counts)), "decoded_sha256": digest(c.decode_many(ids, counts))}

    out = per_batch(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")), convert, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
