"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint bit is set if it is set in over half of the hashes of a text's word shingles. Fingerprints are cut into
segments; every fingerprint is dealt out once for each segment, by the leading bits of that segment. Inside such a
bucket the table of a further segment is searched with the small Hamming ball around each value, and complete
distances decide. Each bucket returns a spanning forest of its links instead of all pairs, so a group of n copies
gives at most n rows a bucket. Components of the forests are the components of all links.

Buckets of very many rows are dealt out again by the values of their further segments, each row to the ball around its
value there, so that no task holds a crowded bucket whole.

Null texts count as empty; empty texts have fingerprint zero and link like any other. Equal fingerprints are one
node. Repeated rows stay repeated. An empty table gives no rows. Texts are read whole, in blocks of bounded memory. Other
columns may have any names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.llm.common import components, forest, per_batch, release, slices, spread_join, staged

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Shingles whose bits are summed at once.
BLOCK = 1 << 14
#: Texts and shingles of a block in which candidates are compared; two blocks meet at a time.
GROUP_TEXTS, GROUP_SHINGLES = 512, 1 << 20
#: Ids (16 bytes each) that may be broadcast; rows of a bucket from which it is dealt out again.
SMALL, CROWDED = 500_000, 200_000


@dataclass(frozen=True)
class Index:
    """How fingerprints are searched.

    bits: length of a fingerprint. distance: links differ in at most so many bits. segments: (first bit, bits) of the
    segments by which fingerprints are dealt out; of each the last ``ball_bits`` bits are left to the ball. balls:
    (first bit, bits) of segments searched inside a bucket with balls of radius one; None: the dealing segment's own.
    """

    bits: int
    distance: int
    segments: tuple[tuple[int, int], ...]
    ball_bits: int = 0
    inner: bool = True

    def balls(self, dealt: int) -> list[tuple[int, int]]:
        """The segments searched with balls inside a bucket of segment number ``dealt``."""
        return [s for k, s in enumerate(self.segments) if k != dealt] if self.inner else [(self.segments[dealt][0], self.ball_bits)]


#: Three errors leave one of four segments untouched, and of the three others one with at most one error: exact.
EXACT_64 = Index(64, 3, tuple((16 * i, 16) for i in range(4)))


#: Fingerprint bits of near duplicates and the bits in which candidates may differ, for tables of every size: at a
#: similarity of 0.8 about 78 bits differ; texts of a few shingles, where it is 96, keep 3.6 standard deviations.
NEAR_BITS, NEAR_DISTANCE = 512, 128


def index_for(documents: int, similarity: float = 0.8, recall: float = 0.99) -> Index:
    """An index of candidates for texts whose shingle sets have at least this Jaccard similarity.

    Sets of similarity s have cosine 2s / (1 + s), and each bit of their fingerprints differs with chance
    p = acos(cosine) / pi. A segment's leading bits (one more with each doubling of the documents, seven at least) must
    agree and its last seven lie in a ball of radius one; there are a quarter more segments than meet a pair with
    chance ``recall``, since they overlap where a fingerprint is too short for them. Of the number of documents only
    the search depends, not fingerprints or distance.
    """
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    ball, lead = 7, max(7, round(np.log2(max(2, documents))) - 12)
    met = (1 - p) ** lead * ((1 - p) ** ball + ball * p * (1 - p) ** (ball - 1))
    n = min(int(np.ceil(1.25 * np.log(1 - recall) / np.log(1 - met))), 256)
    starts = np.linspace(0, NEAR_BITS - lead - ball, n).round().astype(int).tolist()
    return Index(NEAR_BITS, NEAR_DISTANCE, tuple((i, lead + ball) for i in starts), ball, inner=False)


def deduplicate(docs: DataFrame, similarity: float = 0.8, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates: that of the smallest id. All columns stay.

    Two texts are near duplicates if their sets of shingles have at least this Jaccard similarity; groups are the
    components of such pairs. Fingerprints only find candidates: the pairs within a component of candidate links are
    decided by their sets of shingle hashes. Rows without an id can't be named and stay. Of rows that share id and text
    one stays.
    """
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sets = staged(named.mapInArrow(_sketches(size, NEAR_BITS), "id long, fp binary, digest binary, n long"), "sets")
    nodes = staged(sets.groupBy("digest").agg(F.min("id").alias("node"), F.first("fp").alias("fp"), F.first("n").alias("n")), "nodes")
    index = index_for(nodes.count(), similarity)
    near = components(verified_links(named, nodes, components(links(nodes, index)), similarity, size))
    keep = nodes.join(near, "node", "left_anti").select(F.col("node").alias("id"))
    gone = staged(sets.select("id").join(keep, "id", "left_anti").distinct().withColumnRenamed("id", id_col), "gone")
    kept = docs.join(F.broadcast(gone) if gone.count() <= SMALL else gone, id_col, "left_anti")
    twice = staged(sets.groupBy("id").count().where("count > 1").select(F.col("id").alias(id_col)), "twice")
    if twice.isEmpty():
        return kept.select(*docs.columns)
    mark = next(n for n in (f"copy{i or ''}" for i in range(len(docs.columns) + 1)) if n not in {c.lower() for c in docs.columns})
    copy = Window.partitionBy(id_col, F.xxhash64(text_col)).orderBy(id_col)
    first = kept.join(twice, id_col, "left_semi").withColumn(mark, F.row_number().over(copy)).where(F.col(mark) == 1)
    return kept.join(twice, id_col, "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


def _sketches(size: int, bits: int):
    """Of each (id, text): fingerprint, digest and size of the set of shingle hashes."""

    def run(batches):
        for batch in slices(batches):
            out = []
            for text in batch.column(1).to_pylist():
                hashes = np.unique(shingle_hashes(text, size))
                out.append((hash_bits(hashes, bits), xxhash.xxh3_128_digest(hashes.tobytes()), len(hashes)))
            fp, digest, n = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fp, pa.binary()), pa.array(digest, pa.binary()), pa.array(n, pa.int64())], names=["id", "fp", "digest", "n"])

    return run


def jaccard_links(sets: list[np.ndarray], similarity: float, classes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (positions) that join the sets whose Jaccard similarity is high enough; pairs joined already, by links found
    here or by being of one of the ``classes``, are skipped."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    root = np.arange(len(sets)) if classes is None else np.unique(classes, return_inverse=True)[1]
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    order = np.flatnonzero(sizes)  # empty sets equal one another alone
    if len(order) < 2:
        return left[0], right[0]
    values, codes = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes[order])])
    mark = np.zeros(len(values), dtype=np.int32)
    for k, i in enumerate(order[:-1].tolist()):
        rest = order[k + 1 :]
        if (root[rest] == root[i]).all():
            continue
        own = codes[starts[k] : starts[k + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[codes[starts[k + 1] :]], starts[k + 1 : -1] - starts[k + 1])
        mark[own] = 0
        near = rest[(shared >= similarity * (sizes[i] + sizes[rest] - shared) - 1e-9) & (root[rest] != root[i])]
        if len(near):
            joined, first = np.unique(root[near], return_index=True)
            left.append(np.full(len(first), i))
            right.append(near[first])
            root[np.isin(root, joined)] = root[i]
    return np.concatenate(left), np.concatenate(right)


def _decided(named: DataFrame, dealt: DataFrame, similarity: float, size: int) -> DataFrame:
    """Links (a, b) within each group of ``dealt`` (group, node, class, late), by the sets of the nodes' texts. Rows that
    come ``late`` are of one class with all after them, so only the others meet every row."""
    few = dealt.count() <= SMALL
    rows = named.join(F.broadcast(dealt) if few else dealt, named["id"] == dealt["node"]).select("group", "late", "node", "class", "text")

    def hashed(batches):
        for batch in slices(batches):
            found = [np.unique(shingle_hashes(t, size)).tobytes() for t in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(found, pa.binary())], names=["group", "late", "node", "class", "hashes"])

    def decide(batches):
        group, held = None, {}

        def flush():
            keys = list(held)
            x, y = jaccard_links([np.frombuffer(h, np.uint64) for _, _, h in keys], similarity, np.array([c for _, c, _ in keys]))
            node = np.array([n for n, _, _ in keys], dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(node[x]), pa.array(node[y])], names=["a", "b"])

        for batch in slices(batches):
            for g, node, c, h in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if g != group:
                    if len(held) > 1:
                        yield flush()
                    group, held = g, {}
                held[node, c, h] = None
        if len(held) > 1:
            yield flush()

    sets = rows.mapInArrow(hashed, "group long, late boolean, node long, class long, hashes binary")
    return sets.repartition("group").sortWithinPartitions("group", "late").mapInArrow(decide, "a long, b long")


def verified_links(named: DataFrame, nodes: DataFrame, loose: DataFrame, similarity: float, size: int) -> DataFrame:
    """Links (a, b) that join all pairs within components of candidates (node, root) that reach the similarity.

    Large components are dealt into blocks of bounded numbers of texts and of shingles. First each block is decided by
    itself, together with the component's root; what is then joined to the root, as nearly all copies of one text are,
    need not meet each other. Only the texts that are left meet all blocks, each block of them one group with each block
    of all, so that every pair of texts that may still be joined meets while no task holds a whole component.
    """
    members = staged(loose.union(loose.select(F.col("root").alias("node"), "root").distinct()).join(nodes.select("node", "n"), "node").distinct(), "members")
    total = members.count()
    sizes = members.groupBy("root").agg(F.count("*").alias("rows"), F.ceil(F.greatest(F.count("*") / GROUP_TEXTS, F.sum("n") / GROUP_SHINGLES)).cast("int").alias("parts"))
    sizes = staged(sizes, "sizes")
    placed = spread_join(members.select("node", "root"), sizes, "root", "rows", total).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    placed = staged(placed, "placed")
    roots = sizes.where("parts > 1").select(F.col("root").alias("node"), "root", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"))
    diagonal = placed.select("node", "root", "parts", "own").union(roots).distinct()
    diagonal = diagonal.select("node", F.xxhash64("root", "own").alias("group"), F.col("node").alias("class"), F.lit(False).alias("late"))
    first = staged(_decided(named, diagonal, similarity, size), "links")
    if sizes.where("parts > 1").isEmpty():
        return first
    classes = placed.where("parts > 1").join(components(first).withColumnRenamed("root", "class"), "node", "left")
    classes = staged(classes.withColumn("class", F.coalesce("class", "node")), "classes")
    # The root is the smallest node of its component, so also of its class.
    left = classes.where("class <> root")
    rest = left.groupBy("root").agg(F.count("*").alias("rows"), F.ceil(F.count("*") / GROUP_TEXTS).cast("int").alias("others"))
    if rest.isEmpty():
        return first
    others = spread_join(left, rest, "root", "rows", total).withColumn("other", F.pmod(F.xxhash64("node", F.lit(1)), F.col("others")).cast("int"))
    meets = others.select("node", "root", "class", "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own"), F.lit(False).alias("late"))
    whole = sizes.join(rest.select("root", "others"), "root").select("root", "rows", "others")
    each = spread_join(classes, whole, "root", "rows", total).select("node", "root", "class", F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"), "own", F.lit(True).alias("late"))
    dealt = meets.unionByName(each.where("class = root")).unionByName(each.where("class <> root").withColumn("late", F.lit(False)))
    dealt = dealt.select("node", F.xxhash64("root", "other", "own").alias("group"), "class", "late").distinct()
    return first.union(_decided(named, dealt, similarity, size))


def shingles(text: str | None, size: int) -> list[str]:
    words = _WORD.findall((text or "").translate(_LOWER)) if text and not text.islower() else _WORD.findall(text or "")
    if len(words) < size:
        return [" ".join(words)] if words else []
    return list(map(" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    parts = shingles(text, size)
    return np.fromiter((xxhash.xxh64_intdigest(p, 42) for p in parts), dtype=np.uint64, count=len(parts))


def fingerprint(text: str | None, size: int = 3, bits: int = 64) -> bytes:
    """The fingerprint as little-endian bytes."""
    return hash_bits(shingle_hashes(text, size), bits)


def hash_bits(hashes: np.ndarray, bits: int) -> bytes:
    """Majority bits of hashes; further words of 64 bits come from mixing the hashes again."""
    if not len(hashes):
        return bytes(bits // 8)
    counts = np.zeros(bits, dtype=np.int64)
    for start in range(0, len(hashes), BLOCK):
        h = hashes[start : start + BLOCK, None]
        if bits > 64:
            h = h + np.arange(bits // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = np.concatenate([h[:, :1], (mixed ^ (mixed >> np.uint64(31)))[:, 1:]], axis=1)
        counts += np.unpackbits(np.ascontiguousarray(h).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def fingerprints(docs: DataFrame, size: int = 3, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fp binary) of every row."""

    def convert(batch):
        return {"id": batch.column(0), "fp": [fingerprint(t, size, bits) for t in batch.column(1).to_pylist()]}

    out = per_batch(docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text")), convert, "id long, fp binary")
    return out.withColumnRenamed("id", id_col)


def _field(words: np.ndarray, first: int, width: int) -> np.ndarray:
    """Bits first .. first + width of each row's words; a field lies in one word or two."""
    word, shift = divmod(first, 64)
    out = words[:, word] >> np.uint64(shift)
    if shift + width > 64:
        out = out | (words[:, word + 1] << np.uint64(64 - shift))
    return out & np.uint64((1 << width) - 1)


def _block_links(words: np.ndarray, a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows a and the rows b, as a forest; memory is bounded by the block size."""
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    step = max(1, (1 << 20) // max(1, len(b) * words.shape[1]))
    for start in range(0, len(a), step):
        rows = a[start : start + step]
        near = np.bitwise_count(words[rows][:, None, :] ^ words[b][None, :, :]).sum(axis=2, dtype=np.uint16) <= distance
        i, j = np.nonzero(near)
        i, j = rows[i], b[j]
        keep = i != j
        if keep.any():
            x, y = forest(i[keep], j[keep])
            left.append(x)
            right.append(y)
    return np.concatenate(left), np.concatenate(right)


def bucket_links(words: np.ndarray, index: Index, dealt: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside one bucket (row numbers), dealt out by segment number ``dealt``."""
    n = len(words)
    every = np.arange(n)
    if n <= 48:
        return _block_links(words, every, every, index.distance)
    left, right = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for first, width in index.balls(dealt):
        values = _field(words, first, width).astype(np.int64)
        order = np.argsort(values, kind="stable")
        table, starts = np.unique(values[order], return_index=True)
        ends = np.append(starts[1:], n)
        place = {int(v): k for k, v in enumerate(table)}
        flips = [0, *(1 << k for k in range(width))]
        for k, value in enumerate(table.tolist()):
            hits = [m for f in flips if (m := place.get(value ^ f)) is not None and m >= k]
            own = order[starts[k] : ends[k]]
            found = np.concatenate([order[starts[m] : ends[m]] for m in hits])
            if len(found) > 1:
                x, y = _block_links(words, own, found, index.distance)
                left.append(x)
                right.append(y)
    return forest(np.concatenate(left), np.concatenate(right))


def links(nodes: DataFrame, index: Index) -> DataFrame:
    """Forest (a, b) of the links among distinct fingerprints (node long, fp binary)."""
    size, bar = index.bits // 64, CROWDED

    def dealt_keys(words: np.ndarray, k: int) -> np.ndarray:
        first, width = index.segments[k]
        return (_field(words, first + index.ball_bits, width - index.ball_bits).astype(np.int64) << 8) | k

    def count(batches):
        totals: dict[int, int] = {}
        for batch in slices(batches):
            words = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype="<u8").reshape(-1, size)
            for k in range(len(index.segments)):
                for key, n in zip(*(x.tolist() for x in np.unique(dealt_keys(words, k), return_counts=True)), strict=True):
                    totals[key] = totals.get(key, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], names=["bucket", "n"])

    crowded = np.empty(0, np.int64)
    if nodes.count() > bar:  # else no bucket can be; of the dealt rows one in CROWDED makes a crowded one at most
        sizes = nodes.select("fp").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
        crowded = np.array(sorted(r.bucket for r in sizes.where(F.col("n") > bar).collect()), dtype=np.int64)

    def deal(batches):
        for batch in slices(batches):
            node = batch.column(0).to_numpy()
            words = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype="<u8").reshape(-1, size)
            for k in range(len(index.segments)):
                keys = dealt_keys(words, k)
                again = np.isin(keys, crowded)
                some = pa.array(np.flatnonzero(~again))
                yield pa.RecordBatch.from_arrays([pa.array(keys[~again]), pa.array(node[~again]), batch.column(1).take(some)], names=["bucket", "node", "fp"])
                if again.any():
                    rows, own = np.flatnonzero(again), words[again]
                    for at, (first, width) in enumerate(index.balls(k)):
                        values = _field(own, first, width).astype(np.int64)
                        for flip in (0, *(1 << b for b in range(width))):
                            # The sign bit tells these buckets apart; the rest is the crowded bucket, the ball and its centre.
                            name = _mixed(keys[again], at, values ^ flip) | np.int64(-(1 << 63))
                            yield pa.RecordBatch.from_arrays([pa.array((name & ~np.int64(255)) | k), pa.array(node[rows]), batch.column(1).take(pa.array(rows))], names=["bucket", "node", "fp"])

    def search(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush(parts):
            keys, node = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
            words = np.concatenate([p[2] for p in parts])
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            ends = np.append(starts[1:], len(keys))
            sizes = ends - starts
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            small = np.repeat(sizes <= 8, sizes)
            for step in range(1, 8):  # all pairs of small buckets at once
                i = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:])) if len(keys) > step else np.empty(0, np.int64)
                if len(i):
                    i = i[np.bitwise_count(words[i] ^ words[i + step]).sum(axis=1) <= index.distance]
                    a.append(node[i])
                    b.append(node[i + step])
            for s, e in zip(starts[sizes > 8], ends[sizes > 8], strict=True):
                x, y = bucket_links(words[s:e], index, int(keys[s]) & 255)
                a.append(node[s:e][x])
                b.append(node[s:e][y])
            x, y = forest(np.concatenate(a), np.concatenate(b))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, node = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                words = np.frombuffer(b"".join(batch.column(2).to_pylist()), dtype="<u8").reshape(-1, size)
                last = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
                if last:
                    yield flush([*held, (keys[:last], node[:last], words[:last])])
                    held = []
                elif held and held[-1][0][-1] != keys[0]:
                    yield flush(held)
                    held = []
                held.append((keys[last:], node[last:], words[last:]))
            if held:
                yield flush(held)
        finally:
            release()

    dealt = nodes.select("node", "fp").mapInArrow(deal, "bucket long, node long, fp binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(search, "a long, b long")


def _mixed(keys: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """A hash of (bucket, ball, value); where two collide, rows meet that need not, and complete distances decide."""
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + values.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(at + 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(31))).astype(np.int64)


def groups(prints: DataFrame, index: Index, id_col: str = "doc_id") -> DataFrame:
    """(id_col, fp, component_id): component_id is the smallest id reachable over links, itself included.

    Rows with equal fingerprints become one node, named by their smallest id (partially aggregated, so a fingerprint
    that very many rows share is no burden). A row without an id has the component of its fingerprint, null if no row
    with that fingerprint has an id.
    """
    prints = staged(prints, "prints")
    nodes = staged(prints.groupBy("fp").agg(F.min(id_col).alias("node"), F.count("*").alias("n")), "nodes")
    found = components(links(nodes.where(F.col("node").isNotNull()), index))  # node -> smallest node, which is the smallest id of the component
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("root", "node").alias("component_id"), "n")
    return spread_join(prints, named, "fp", "n", prints.count()).select(id_col, "fp", "component_id")
