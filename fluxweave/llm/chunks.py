"""Token ids of many texts at once: chunks between blanks are told apart in Arrow, each distinct one is looked up once, and
ids are gathered by their numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: white space other than blanks and line ends, as a class of the RE2 syntax.
ODD_SPACE = r"[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Letters of words and marks that are a piece of their own after one.
LETTERS, MARKS = "[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", ".,;:!?"


def odd_texts(texts: pa.Array, names: list[str] | tuple[str, ...] = ()) -> np.ndarray:
    """Mask of the texts with white space that may join what blanks part, or with one of the names in them."""
    found = [pc.match_substring(texts, "  "), pc.match_substring(texts, "\n "), pc.match_substring_regex(texts, ODD_SPACE)]
    found += [pc.match_substring(texts, x) for x in names]
    return np.logical_or.reduce([f.to_numpy(zero_copy_only=False) for f in found])


def gathered_ids(texts: pa.Array, whole: np.ndarray, plain, head, chunk, word=None, marks: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts) of texts without nulls, one after the other.

    All look-ups give ids as little-endian 32-bit bytes: ``plain`` of a text in the mask ``whole``, ``head`` of what stands
    before another text's first blank, ``chunk`` of what follows a blank up to the next. With ``word`` letters alone are
    looked up there, and one of MARKS after them in ``marks``.
    """
    n = len(texts)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    parts = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")
    offsets = parts.offsets.to_numpy()
    first = offsets[:-1] - offsets[0]
    values = parts.flatten()
    heads = [plain(texts[i].as_py()) if w else head(h) for i, (w, h) in enumerate(zip(whole.tolist(), values.take(pa.array(first)).to_pylist(), strict=True))]
    coded = values.dictionary_encode()
    distinct, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int32)
    # A chunk is one entry or, as a word and a mark, two; an empty one fills the place of the second.
    if word is None:
        simple = np.zeros(len(distinct), dtype=bool)
        found, empty = [b""], 0
    else:
        simple = pc.match_substring_regex(distinct, f"^{LETTERS}+[{MARKS}]?$").to_numpy(zero_copy_only=False)
        found, empty = [*marks, b""], len(MARKS)
    one, two = np.empty(len(distinct) + n, dtype=np.int32), np.full(len(distinct) + n, empty, dtype=np.int32)
    if simple.any():
        words = distinct.filter(pa.array(simple))
        stems = pc.utf8_rtrim(words, characters=MARKS)
        marked = pc.not_equal(pc.binary_length(stems), pc.binary_length(words)).to_numpy(zero_copy_only=False)
        ends = np.full(len(words), empty)
        ends[marked] = pc.index_in(pc.utf8_slice_codeunits(words.filter(pa.array(marked)), start=-1), pa.array(list(MARKS))).to_numpy(zero_copy_only=False)
        stems = stems.dictionary_encode()
        one[np.flatnonzero(simple)], two[np.flatnonzero(simple)] = stems.indices.to_numpy() + len(found), ends
        found += map(word, stems.dictionary.to_pylist())
    others = distinct.filter(pa.array(~simple)).to_pylist()
    one[np.flatnonzero(~simple)] = np.arange(len(found), len(found) + len(others))
    found += map(chunk, others)
    one[len(distinct) :] = np.arange(len(found), len(found) + n)
    found += heads
    codes[first] = np.arange(len(distinct), len(distinct) + n)
    size = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
    entries = np.empty(2 * len(codes), dtype=np.int32)
    entries[::2], entries[1::2] = one[codes], two[codes]
    counts = np.add.reduceat(size[entries], 2 * first)
    return np.frombuffer(b"".join(found), "<u4")[places(size, entries)], counts


def places(size: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Where the values of the entries lie, one after the other, in a row of all entries of these sizes."""
    lengths = size[entries]
    begin = np.cumsum(size) - size
    kind = np.int32 if size.sum() < 1 << 31 and lengths.sum() < 1 << 31 else np.int64
    at = np.repeat((begin[entries] - np.cumsum(lengths) + lengths).astype(kind), lengths)
    at += np.arange(len(at), dtype=kind)
    return at
