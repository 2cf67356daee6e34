"""Token-id files of directly addressable codes.

The ids of a section are split into chunks of eight bits, lowest first. Level k holds the k-th chunk of every id that
has one; a bitmap beside each level tells which of its ids go on, and a rank directory counts the set bits before every
block of 512. So the chunk of token i at the next level is found by one rank, and any token can be read from a few
bytes at known places, without decoding what stands before it. A file is a row of sections, the manifest has one row a
section with the number of tokens before it.

Tokens come from the tokenizers library. Its pre-tokenizer and model are run once for each distinct chunk of text
between blanks, so far as a bounded memo holds; texts in which that could differ from the whole text's tokens (white
space that blanks don't part, special tokens) go through the library whole.

Null and empty texts hold the end id alone; an empty table gives no file. Rows of one id follow each other in the order
of their texts' hashes, rows without an id come first and stay without one. Very long texts are a section of their own.
Other columns of the table are not looked at, whatever their names. Files are written to shared storage under names that
no other attempt of the task uses and are found only through the manifest of the attempts that succeeded, so lost
executors cost a retry and nothing else.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.llm.chunks import MARKS, gathered_ids, odd_texts
from fluxweave.llm.common import filesystem, fresh_path, release, slices, staged

MAGIC = b"DAC2"
RANK_BITS = 512
_HEAD = struct.Struct("<4sIQQQ")  # magic, levels, documents, ids, place of the level table
_LEVEL = struct.Struct("<QQQQ")  # entries, places of chunks, bitmap, ranks
#: Tokens after which a new section begins, bytes after which a new file does, bytes that one task reads back.
SECTION_TOKENS, FILE_BYTES, TASK_BYTES = 500_000, 256 << 20, 8 << 20
#: Tokens decoded at once where whole documents allow it; entries after which a memo starts afresh.
SLICE_TOKENS, MEMO = 250_000, 300_000
#: Bytes of texts whose chunks are told apart at once.
TEXT_BYTES = 8 << 20
#: Letters of words and marks that are a piece of their own after one.
LETTERS, MARKS = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", ".,;:!?"


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One section's bytes: header, document directory (ids, starts, bits of the ids that are there), levels, level table."""
    starts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    named = np.array([i is not None for i in doc_ids], dtype=bool)
    body = [np.array([i or 0 for i in doc_ids], dtype="<i8").tobytes(), starts.tobytes(), np.packbits(named, bitorder="little").tobytes()]
    at, table, rest = _HEAD.size + sum(map(len, body)), [], ids.astype(np.uint32)
    while True:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % (RANK_BITS // 8), np.uint8)])
        ones = np.bitwise_count(bits).reshape(-1, RANK_BITS // 8).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        parts = [(rest & 255).astype(np.uint8).tobytes(), bits.tobytes(), ranks.tobytes()]
        places = np.cumsum([at, *map(len, parts)]).tolist()
        table.append(_LEVEL.pack(len(rest), *places[:3]))
        body += parts
        at = places[3]
        rest = rest[more] >> 8
        if not len(rest):
            break
    return _HEAD.pack(MAGIC, len(table), len(doc_ids), len(ids), at) + b"".join(body) + b"".join(table)


class TokenFile:
    """Reader over ``read(offset, length) -> bytes``; touches only the bytes it needs."""

    def __init__(self, read):
        self.read = read
        magic, levels, self.documents, self.tokens, place = _HEAD.unpack(read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        self.levels = list(_LEVEL.iter_unpack(read(place, levels * _LEVEL.size)))

    def directory(self) -> tuple[list[int | None], np.ndarray]:
        """(document ids, starts); starts has one entry more, the end of the last document."""
        n = self.documents
        raw = self.read(_HEAD.size, 8 * (2 * n + 1) + -(-n // 8))
        named = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 * (2 * n + 1)), count=n, bitorder="little")
        ids = np.frombuffer(raw, "<i8", n).tolist()
        return [i if there else None for i, there in zip(ids, named.tolist(), strict=True)], np.frombuffer(raw, "<u8", n + 1, offset=8 * n).astype(np.int64)

    def _rank(self, level: int, i: int) -> int:
        _, _, bitmap, ranks = self.levels[level]
        block, bit = divmod(i, RANK_BITS)
        ahead = np.frombuffer(self.read(bitmap + block * RANK_BITS // 8, bit // 8 + 1), np.uint8)
        last = int(ahead[-1]) & ((1 << bit % 8) - 1)
        return struct.unpack("<Q", self.read(ranks + 8 * block, 8))[0] + int(np.bitwise_count(ahead[:-1]).sum()) + last.bit_count()

    def token(self, i: int) -> int:
        """The i-th token by one rank a level."""
        value, level = 0, 0
        while True:
            _, chunks, bitmap, _ = self.levels[level]
            value |= self.read(chunks + i, 1)[0] << (8 * level)
            if not self.read(bitmap + i // 8, 1)[0] >> (i % 8) & 1:
                return value
            i, level = self._rank(level, i), level + 1

    def slice(self, start: int, end: int) -> np.ndarray:
        """Tokens start .. end; reads each level's part alone."""
        out = np.zeros(end - start, dtype=np.uint32)
        where: np.ndarray | slice = slice(None)
        level = 0
        while end > start:
            _, chunks, bitmap, _ = self.levels[level]
            out[where] |= np.frombuffer(self.read(chunks + start, end - start), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            first = start // 8
            bits = np.unpackbits(np.frombuffer(self.read(bitmap + first, (end + 7) // 8 - first), np.uint8), bitorder="little")
            more = np.flatnonzero(bits[start - 8 * first : end - 8 * first]).astype(np.int32)
            if not len(more):
                break
            where = more if isinstance(where, slice) else where[more]
            start = self._rank(level, start)
            end, level = start + len(more), level + 1
        return out


class Encoder:
    """The tokenizers library with a memo of distinct chunks.

    ``plain_specials``: whether the strings of special tokens are read as ordinary text, as the library does on request;
    else they are tokens, as by its default.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        added = [] if plain_specials else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = added
        split, model = self.tokenizer.pre_tokenizer, self.tokenizer.model
        # Only this pre-tokenizer is known to start a new piece at each blank that stands alone.
        self.cuts = isinstance(split, pre_tokenizers.ByteLevel) and self.tokenizer.normalizer is None and not split.add_prefix_space

        class Pieces(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) > MEMO // 4:
                    self.clear()
                found = array("I", [t.id for t in model.tokenize(piece)]).tobytes()
                if len(piece) <= 64:
                    self[piece] = found
                return found

        # How the library writes the bytes of letters beyond ASCII.
        wide = {c: split.pre_tokenize_str(chr(c))[0][0] for c in range(0xAA, 0x250) if chr(c).isalpha()} if self.cuts else {}

        class Words(dict):  # letters that follow a blank, which are one piece with it
            def __missing__(self, word: str) -> bytes:
                if len(self) > MEMO:
                    self.clear()
                found = array("I", [t.id for t in model.tokenize("\u0120" + (word if word.isascii() else word.translate(wide)))]).tobytes()
                if len(word) <= 64:
                    self[word] = found
                return found

        class Chunks(dict):  # of any kind, with the blank before them or without
            def __init__(self, blank: str):
                self.blank = blank

            def __missing__(self, chunk: str) -> bytes:
                if len(self) > MEMO // 4:
                    self.clear()
                found = b"".join([pieces[p] for p, _ in split.pre_tokenize_str(self.blank + chunk)])
                if len(chunk) <= 64:
                    self[chunk] = found
                return found

        self.pieces = pieces = Pieces()
        self.words, self.chunks, self.heads = Words(), Chunks(" "), Chunks("")
        self.marks = [pieces[m] for m in MARKS] if self.cuts else []

    def plain(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of texts without nulls, one after the other.

        A piece never goes on over a blank after something other than white space, so a text in which blanks stand alone
        is cut before each blank; all others are encoded whole. Chunks are told apart in Arrow, each distinct one is
        looked up once, and ids are gathered by their numbers.
        """
        whole = np.ones(len(texts), dtype=bool) if not self.cuts else odd_texts(texts, self.special)
        return gathered_ids(texts, whole, self.plain, self.heads.__getitem__, self.chunks.__getitem__, self.words.__getitem__ if self.cuts else None, self.marks)

    def forget(self) -> None:
        for memo in (self.pieces, self.words, self.chunks, self.heads):
            memo.clear()
        self.tokenizer.model._clear_cache()


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", plain_specials: bool = False) -> DataFrame:
    """Encode every text and write files in ascending id order below ``folder``.

    Returns the manifest (part, seq, uri, place, length, documents, tokens, start), ``start`` counting the tokens of all
    sections before; one row a section, read from the manifest's own table.
    """
    ordered = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ordered = ordered.withColumn("tie", F.xxhash64("text")).repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    def run(batches):
        from fluxweave.llm import tokenfile

        encoder = tokenfile._ENCODERS.get((tokenizer, plain_specials)) or tokenfile.Encoder(tokenizer, plain_specials)
        tokenfile._ENCODERS[tokenizer, plain_specials] = encoder
        files, base = filesystem(folder)
        part, seq, sink, uri, place = TaskContext.get().partitionId(), 0, None, "", 0
        ids: list[int | None] = []
        counts: list[np.ndarray] = []
        held: list[np.ndarray] = []
        size = 0

        def flush():
            nonlocal sink, uri, place, seq, ids, counts, held, size
            if sink is None or place >= FILE_BYTES:
                if sink:
                    sink.close()
                files.create_dir(base, recursive=True)
                name = f"{part:08d}-{seq:06d}-{uuid.uuid4().hex}.dac"
                sink, uri, place = files.open_output_stream(f"{base}/{name}", compression=None), f"{folder}/{name}", 0
            data = pack(ids, np.concatenate(counts), np.concatenate(held))
            sink.write(data)
            row = [[part], [seq], [uri], [place], [len(data)], [len(ids)], [size]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            ids, counts, held, size, seq, place = [], [], [], 0, seq + 1, place + len(data)
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "seq", "uri", "place", "length", "documents", "tokens"])

        try:
            for batch in gathered(batches, TEXT_BYTES):
                found, n = encoder.encode(batch.column(1))
                tokens = np.full(len(found) + len(n), end_id, dtype="<u4")
                ends = np.cumsum(n + 1)
                tokens[np.delete(np.arange(len(tokens), dtype=np.int64), ends - 1)] = found
                names, first = batch.column(0).to_pylist(), 0
                while first < len(names):  # up to the document that fills the section
                    taken = int(ends[first - 1]) if first else 0
                    last = min(len(names), int(np.searchsorted(ends, taken + SECTION_TOKENS - size)) + 1)
                    ids += names[first:last]
                    counts.append(n[first:last] + 1)
                    held.append(tokens[taken : int(ends[last - 1])])
                    size += int(ends[last - 1]) - taken
                    first = last
                    if size >= SECTION_TOKENS:
                        yield flush()
            if ids:
                yield flush()
        finally:
            if sink:
                sink.close()
            release()

    manifest = staged(ordered.mapInArrow(run, "part int, seq int, uri string, place long, length long, documents long, tokens long"), "manifest")
    # Running sums in two levels: over the parts, of which there are no more than tasks, and over the sections of each.
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    parts = parts.select("part", F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    before = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.join(parts, "part").withColumn("start", (F.col("ahead") + F.coalesce(F.sum("tokens").over(before), F.lit(0))).cast("long"))
    return placed.select("part", "seq", "uri", "place", "length", "documents", "tokens", "start")


def gathered(batches, limit: int):
    """Batches joined or cut to about ``limit`` bytes each."""
    held, size = [], 0
    for part in slices(batches, limit):
        held.append(part)
        size += part.nbytes
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def opened(source, place: int = 0) -> TokenFile:
    """The section at ``place`` of an open file."""
    return TokenFile(lambda at, size: source.read_at(size, place + at))


def read(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids binary) of every document, from the sections of a manifest, about TASK_BYTES a task."""

    def run(batches):
        from fluxweave.llm import tokenfile

        for encoder in tokenfile._ENCODERS.values():  # of writing tasks that this worker ran before
            encoder.forget()
        try:
            for batch in batches:
                for uri, place, base in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    files, path = filesystem(uri)
                    with files.open_input_file(path) as source:
                        section = opened(source, place)
                        ids, starts = section.directory()
                        first = 0
                        while first < len(ids):
                            last = max(first + 1, int(np.searchsorted(starts, starts[first] + SLICE_TOKENS, side="right")) - 1)
                            s = starts[first : last + 1]
                            tokens = section.slice(int(s[0]), int(s[-1])).astype("<u4", copy=False)
                            offsets = pa.array((s - s[0]) * 4, pa.int64()).cast(pa.int32()) if s[-1] - s[0] < 1 << 29 else None
                            if offsets is None:
                                own = pa.array([tokens[a - s[0] : b - s[0]].tobytes() for a, b in zip(s[:-1].tolist(), s[1:].tolist(), strict=True)], pa.binary())
                            else:
                                own = pa.Array.from_buffers(pa.binary(), len(s) - 1, [None, offsets.buffers()[1], pa.py_buffer(tokens)])
                            cols = [pa.array(ids[first:last], pa.int64()), pa.array(s[:-1] + base, pa.int64()), pa.array(np.diff(s), pa.int64()), own]
                            yield pa.RecordBatch.from_arrays(cols, names=["id", "start", "n_tokens", "ids"])
                            first = last
        finally:
            release()

    size = manifest.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    dealt = manifest.select("uri", "place", "start").repartition(max(1, -(-size // TASK_BYTES)), "uri", "place")
    return dealt.mapInArrow(run, "id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0, plain_specials: bool = False) -> DataFrame:
    """Write all documents, read the files back: (id, start, n_tokens, ids)."""
    return read(write(docs, tokenizer, fresh_path(docs.sparkSession, "tokens"), end_id, plain_specials=plain_specials))


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
