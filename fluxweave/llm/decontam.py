"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are compared as lower-case words. All n-grams of the test items go into an Aho-Corasick automaton. A first pass
over all documents counts in how many each stands; an item's seeds are its n-grams that stand in at most ``rare`` of
the documents, and in any case the rarer half of them, so that an item copied everywhere keeps its seeds. A second pass
joins passages to items by seeds: where at least two distinct seeds of an item (one, if it has few) lie within twice
its length, the passage around them is aligned with the item, and the local alignment's score over the item's own is
kept if it reaches ``least``. So edited copies are found as well as exact ones.

Items are worked through in blocks of bounded size, one pass each; a block's items and seeds are written to the shared
folder and read by the tasks, so neither the driver nor a task holds more than one block. Null and empty texts match
nothing; items without words are passed over; shorter items than n words are one seed. Repeated rows give repeated
results, repeated items each their own. Of equally good passages of a document the one with more seeds, then the later
one, is reported. Empty tables of documents or items give no rows. Texts are scanned whole; long ones are aligned in
overlapping windows. Columns may have any names; only those that are named are looked at.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fluxweave.llm.common import filesystem, fresh_path, slices, staged

SIZE = 3
RARE = 0.001
LEAST = 0.5
MATCH, MISS, GAP = 2, -1, -1
#: Characters of items in one block; a larger benchmark takes more passes.
BLOCK_CHARS = 2_000_000
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Lower-case words; each is one word of the text as it stands, so that places can be told."""
    low = (text or "").lower()
    return _WORD.findall(low) if len(low) == len(text or "") else [w.lower() for w in _WORD.findall(text)]


def grams(tokens: list[str], size: int = SIZE) -> list[str]:
    if len(tokens) < size:
        return [" ".join(tokens)] if tokens else []
    return [" ".join(tokens[i : i + size]) for i in range(len(tokens) - size + 1)]


def automaton(patterns):
    """Patterns are found as whole words: each is framed by blanks, as is the text."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for p in patterns:
        found.add_word(f" {p} ", p)
    found.make_automaton()
    return found


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman with linear gaps: (best score, first and past-the-last place in ``text``)."""

    def run(a, b):
        steps = np.arange(len(b) + 1) * GAP
        above = np.zeros(len(b) + 1)
        best, end, row = 0.0, 0, 0
        for i, x in enumerate(a):
            here = np.zeros(len(b) + 1)
            here[1:] = np.maximum(0, np.maximum(above[:-1] + np.where(b == x, MATCH, MISS), above[1:] + GAP))
            above = np.maximum.accumulate(here - steps) + steps
            top = int(above.argmax())
            if above[top] > best:
                best, end, row = float(above[top]), top, i + 1
        return best, end, row

    best, end, row = run(item, text)
    if not best:
        return 0.0, 0, 0
    _, back, _ = run(item[:row][::-1], text[:end][::-1])
    return best, end - back, end


class Items:
    """One block of test items."""

    def __init__(self, items: list[tuple[int, str]], size: int = SIZE):
        self.tokens = {k: w for k, (_, t) in enumerate(items) if (w := words(t))}
        self.ids = {k: items[k][0] for k in self.tokens}
        self.grams = {k: grams(w, size) for k, w in self.tokens.items()}

    def patterns(self) -> set[str]:
        return {g for each in self.grams.values() for g in each}

    def seeds(self, counts: dict[str, int], documents: int, rare: float = RARE) -> dict[str, list[int]]:
        """Seed -> items; ``counts`` are the documents in which each n-gram stands."""
        out: dict[str, list[int]] = defaultdict(list)
        for k, each in self.grams.items():
            distinct = sorted(set(each), key=lambda g: (counts.get(g, 0), g))
            half = counts.get(distinct[(len(distinct) - 1) // 2], 0)
            for g in distinct:
                if counts.get(g, 0) <= max(half, rare * documents):
                    out[g].append(k)
        return out


class Finder:
    def __init__(self, items: Items, seeds: dict[str, list[int]], least: float = LEAST):
        self.items, self.seeds, self.least = items, seeds, least
        self.matcher = automaton(seeds)
        self.enough = {k: 2 if len(set(g)) >= 4 else 1 for k, g in items.grams.items()}

    def find(self, text: str | None) -> list[tuple[int, float, int, int, int]]:
        """(item id, score, seeds, start, end) of each item in a text: its best passage, places in code points."""
        tokens = words(text)
        line = f" {' '.join(tokens)} "
        hits: dict[int, list[tuple[int, str]]] = defaultdict(list)
        for end, gram in self.matcher.iter(line):
            for k in self.seeds[gram]:
                hits[k].append((end + 1 - len(gram) - 2, gram))
        out = []
        if hits:
            starts = np.cumsum([0, *(len(w) + 1 for w in tokens)])
            for k, places in hits.items():
                item = self.items.tokens[k]
                spots = [(int(np.searchsorted(starts, p)), g) for p, g in places]
                best = (0.0, 0, 0, 0)
                group: list[tuple[int, str]] = []
                for spot in [*spots, (1 << 60, "")]:
                    if group and spot[0] - group[-1][0] > 2 * len(item):
                        distinct = len({g for _, g in group})
                        if distinct >= self.enough[k]:
                            best = max(best, self.passage(item, tokens, group[0][0], group[-1][0], distinct))
                        group = []
                    group.append(spot)
                if best[0] >= self.least:
                    out.append((k, *best))
        if not out:
            return []
        bounds = [m.span() for m in _WORD.finditer(text)]
        return [(self.items.ids[k], s, n, bounds[a][0], bounds[b - 1][1]) for k, s, n, a, b in out]

    def passage(self, item: list[str], tokens: list[str], first: int, last: int, distinct: int) -> tuple[float, int, int, int]:
        """Align the passage around a run of seeds; a long run is taken in overlapping windows."""
        numbers = {w: i for i, w in enumerate(dict.fromkeys(item))}
        code = np.array([numbers[w] for w in item])
        best = (0.0, 0, 0, 0)
        lo, stop = max(0, first - len(item)), min(len(tokens), last + 2 * len(item))
        while True:
            hi = min(stop, lo + 8 * len(item))
            window = np.array([numbers.get(w, -1) for w in tokens[lo:hi]])
            score, a, b = align(code, window)
            best = max(best, (score / (MATCH * len(item)), distinct, lo + a, lo + b))
            if hi == stop:
                return best
            lo += 4 * len(item)


def blocks(items: DataFrame, id_col: str, text_col: str):
    """Lists of (id, text) of bounded size."""
    held, size = [], 0
    for r in items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null").orderBy("id", "text").toLocalIterator():
        if held and size + len(r.text) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((r.id, r.text))
        size += len(r.text)
    if held:
        yield held


def finders(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SIZE, rare: float = RARE, least: float = LEAST):
    """For each block of items the URI of what ``Finder`` takes; counts come from all documents."""
    spark = docs.sparkSession
    for block in blocks(items, item_id, item_text):
        held = Items(block, size)
        if not held.grams:
            continue
        uri = fresh_path(spark, "items")
        store(uri, held)

        def count(batches, uri=uri):
            patterns = sorted(load(uri).patterns())
            matcher, totals, rows = automaton(patterns), Counter(), 0
            for batch in slices(batches):
                for text in batch.column(0).to_pylist():
                    rows += 1
                    totals.update({g for _, g in matcher.iter(f" {' '.join(words(text))} ")})
            totals[""] = rows
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.array(list(totals.values()), pa.int64())], names=["gram", "n"])

        counted = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "gram string, n long")
        counts = {r.gram: r.n for r in counted.groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # one row an n-gram of the block
        documents = counts.pop("", 0)
        uri = fresh_path(spark, "seeds")
        store(uri, (held, dict(held.seeds(counts, documents, rare)), least))
        yield uri


def store(uri: str, value) -> None:
    """A value of this module's own making, written once below the shared folder."""
    files, path = filesystem(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    with files.open_output_stream(path) as sink:
        sink.write(pickle.dumps(value))


def load(uri: str):
    files, path = filesystem(uri)
    with files.open_input_file(path) as source:
        return pickle.loads(source.read())


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, item_id, score, seeds, start, end): every document and item that share a passage."""
    schema = "id long, item_id long, score double, seeds int, start long, end long"
    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int64(), pa.int64()]
    lean = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = None
    for uri in finders(docs, items, text_col, **options):

        def run(batches, uri=uri):
            finder = Finder(*load(uri))
            for batch in slices(batches):
                rows = [(i, *hit) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for hit in finder.find(t)]
                cols = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["id", "item_id", "score", "seeds", "start", "end"])

        found = lean.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    out = docs.sparkSession.createDataFrame([], schema) if out is None else out
    return out.withColumnRenamed("id", id_col)


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that share a passage with no item; all columns stay, nothing is shuffled. Each further block of
    items works on what the one before left, written to the shared folder."""
    at, left = docs.columns.index(text_col), docs
    for n, uri in enumerate(list(finders(docs, items, text_col, **options))):

        def run(batches, uri=uri):
            finder = Finder(*load(uri))
            for batch in slices(batches):
                yield batch.filter(pa.array([not finder.find(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        left = (staged(left, "clean") if n else left).mapInArrow(run, docs.schema)
    return left
