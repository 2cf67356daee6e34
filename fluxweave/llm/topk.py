"""Exact top-k inner products by a Voronoi join.

Rows go to the cell of their nearest pivot, queries likewise; cells of queries are joined to groups around fewer
pivots. A group's summary is its centre c, its radius u (so every query is c + e with |e| <= u) and its bound: the least,
over its queries, k-th best score against a bounded set of real rows, which no query's final k-th best can fall below.
A cell's summary is its number of rows, its pivot p and its radius r. No row s scores above c.s + u |s| for any query of
the group, and no row of a cell above c.p + |c| r + u (|p| + r). So a cell whose bound is too low for a group is passed over
whole, and of the others only rows whose own bound reaches the group's are sent to it: rows are replicated no further
than they may be needed. Groups meet their rows in blocks of bounded size, each solved by one matrix product, and the
blocks' best rows are merged by rank.

How many groups there are is chosen by what the bounds would cost on the same bounded set of rows: where vectors lie
apart many small groups each need few rows, where they don't, few large groups copy the rows less often. Results are the
same for any number.

Components are floor(scale * x). Null vectors and vectors with null or non-finite components (before or after scaling)
take no part, nor do rows without an id; vectors of unequal length are compared over their shared leading components; an
empty vector scores 0. Rows that share a query's id are its own; queries that share an id are one list of answers, the
best over all of them. Repeated rows are candidates each. Equal scores go to the smaller id. Sums that could pass 2**53
are taken in whole numbers of any size and held to 64 bits at the end; bounds that overflow count as reached. An empty
table gives no rows; other columns of the table are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fluxweave.llm.common import release, slices, staged

#: Rows whose true scores bound each query's k-th best from below; fixed, whatever the input.
WITNESSES = 2048
#: Pivots at most; rows and queries of a block; products that moving one row is reckoned to cost.
PIVOTS, BLOCK_ROWS, QUERY_ROWS, MOVE = 4096, 32_768, 4096, 64
_LIMIT = (1 << 63) - 1


def whole_vectors(vectors: DataFrame, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """(id, v binary, n): scaled and floored, with the number of components, without rows that take no part."""

    def run(batches):
        for batch in slices(batches):
            ids, packed, sizes = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = v.values
                if i is None or values is None or values.null_count:
                    continue
                x = np.asarray(values.to_numpy(zero_copy_only=False), dtype=np.float64)
                with np.errstate(over="ignore"):
                    x = np.floor(scale * x)
                if np.isfinite(x).all():
                    ids.append(i)
                    packed.append(pack(x))
                    sizes.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(packed, pa.binary()), pa.array(sizes, pa.int32())], names=["id", "v", "n"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(run, "id long, v binary, n int")


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as the narrowest type that holds them; the first byte tells its width."""
    most = np.abs(x).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return bytes([int(kind[2])]) + x.astype(kind).tobytes()


def unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, {2: "<i2", 4: "<i4", 8: "<f8"}[packed[0]], offset=1).astype(np.float64)


def matrix(packed, width: int) -> np.ndarray:
    """Rows of one width, shorter ones filled with zeros."""
    packed = list(packed)
    if packed and all(len(p) == 2 * width + 1 and p[0] == 2 for p in packed):
        return np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), 2 * width + 1)[:, 1:].copy().view("<i2").astype(np.float64)
    return np.stack([np.pad(x := unpack(p), (0, width - len(x))) for p in packed]) if packed else np.empty((0, width))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number rows."""
    with np.errstate(over="ignore"):
        most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    exact = np.frompyfunc(int, 1, 1)
    out = exact(a).astype(object).dot(exact(b).astype(object).T)
    return np.frompyfunc(lambda x: max(-_LIMIT - 1, min(_LIMIT, x)), 1, 1)(out).astype(np.int64)


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the earlier place."""
    if len(scores) > k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > bar)
        places = np.concatenate([above, np.flatnonzero(scores == bar)[: k - len(above)]])
    else:
        places = np.arange(len(scores))
    return np.array(sorted(places.tolist(), key=lambda p: (-int(scores[p]), p)), dtype=np.int64)


def nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot nearest to each row; where distances overflow it is any one, the same each time."""
    with np.errstate(over="ignore", invalid="ignore"):
        square = (pivots * pivots).sum(axis=1)[None, :] - 2 * x @ pivots.T
    return np.nan_to_num(square, nan=np.inf).argmin(axis=1) if len(x) else np.empty(0, np.int64)


def spread(x: np.ndarray, most: int) -> np.ndarray:
    """At most so many distinct rows of x, each the farthest from those before."""
    chosen, far = [0], np.full(len(x), np.inf)
    while len(chosen) < most:
        with np.errstate(over="ignore", invalid="ignore"):
            far = np.minimum(far, np.nan_to_num(((x - x[chosen[-1]]) ** 2).sum(axis=1), nan=0.0))
        at = int(far.argmax())
        if not far[at] > 0:
            break
        chosen.append(at)
    return x[chosen]


def reaches(bound: np.ndarray, bar) -> np.ndarray:
    """Whether a bound, a little raised for rounding, is at least ``bar``; one that overflowed is."""
    with np.errstate(over="ignore", invalid="ignore"):
        return ~(bound + 1e-9 * np.abs(bound) + 1e-6 < bar)


def upper(x: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """No row of x scores above this for a query within ``radii`` of ``centres``: rows by groups."""
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt((x * x).sum(axis=1))
        slack = 1e-9 * norms[:, None] * np.sqrt((centres * centres).sum(axis=1))[None, :]
        return x @ centres.T + norms[:, None] * radii[None, :] + slack


class Plan:
    """Pivots of cells, and groups of query cells with their summaries."""

    def __init__(self, rows: DataFrame, k: int, every: int):
        n, width, n_queries = rows.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0)), F.count_if(F.col("id") % every == 0)).first()
        self.width, self.n = width, n
        n_pivots = max(1, min(PIVOTS, int(math.sqrt(n))))
        seen = rows.orderBy(F.xxhash64("id", "v")).limit(max(WITNESSES, n_pivots)).collect()  # a bounded set
        self.w_ids = np.array([r.id for r in seen], dtype=np.int64)
        self.witnesses = matrix([bytes(r.v) for r in seen], width)
        self.pivots = spread(self.witnesses, n_pivots) if n else np.zeros((1, width))
        cells, pivots, witnesses, w_ids = len(self.pivots), self.pivots, self.witnesses, self.w_ids

        def judge(batches):
            for batch in slices(batches):
                ids = batch.column(0).to_numpy()
                q = matrix(batch.column(1).to_pylist(), width)
                scores = products(q, witnesses).astype(np.float64)
                scores[ids[:, None] == w_ids[None, :]] = -np.inf
                bar = np.sort(scores, axis=1)[:, -k] if scores.shape[1] >= k else np.full(len(ids), -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(1), pa.array(nearest(q, pivots), pa.int32()), pa.array(bar)], names=["id", "v", "cell", "bar"])

        self.queries = staged(rows.select("id", "v").where(F.col("id") % every == 0).mapInArrow(judge, "id long, v binary, cell int, bar double"), "queries")

        def widths(batches):  # of each query cell: radius and bound, by task
            far, low, count = np.full(cells, -1.0), np.full(cells, np.inf), np.zeros(cells, np.int64)
            for batch in slices(batches):
                cell = batch.column(1).to_numpy()
                with np.errstate(over="ignore", invalid="ignore"):
                    d = np.nan_to_num(np.sqrt(((matrix(batch.column(0).to_pylist(), width) - pivots[cell]) ** 2).sum(axis=1)), nan=np.inf)
                np.maximum.at(far, cell, d)
                np.minimum.at(low, cell, batch.column(2).to_numpy())
                np.add.at(count, cell, 1)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(far[some]), pa.array(low[some]), pa.array(count[some])], names=["cell", "far", "bar", "n"])

        found = self.queries.select("v", "cell", "bar").mapInArrow(widths, "cell int, far double, bar double, n long").groupBy("cell").agg(F.max("far").alias("far"), F.min("bar").alias("bar"), F.sum("n").alias("n"))
        held = sorted((r.cell, r.far, r.bar, r.n) for r in found.collect())  # one row a pivot
        cell = np.array([h[0] for h in held], dtype=np.int64)
        far, bar, count = (np.array([h[i] for h in held], dtype=np.float64) for i in (1, 2, 3))
        options = []
        size = 1
        while len(held):
            lead = self.pivots[cell[np.argsort(-count, kind="stable")[:size]]]
            group = nearest(self.pivots[cell], lead)
            centres, radii, bars, sizes = [], [], [], []
            for g in range(len(lead)):
                own = group == g
                if own.any():
                    weight = np.minimum(count[own], 1e15)[:, None]
                    with np.errstate(over="ignore", invalid="ignore"):
                        c = (self.pivots[cell[own]] * (weight / weight.sum())).sum(axis=0)
                        radii.append(np.nan_to_num((np.sqrt(((self.pivots[cell[own]] - c) ** 2).sum(axis=1)) + far[own]).max(), nan=np.inf))
                    centres.append(c)
                else:
                    centres.append(lead[g])
                    radii.append(0.0)
                bars.append(bar[own].min(initial=np.inf))
                sizes.append(count[own].sum())
            summary = [np.array(x) for x in (centres, radii, bars, sizes)]
            share = reaches(upper(self.witnesses, summary[0], summary[1]), summary[2][None, :]).mean(axis=0)
            options.append((float((share * (MOVE + summary[3])).sum()), size, group, *summary))
            if size >= len(held):
                break
            size = min(4 * size, len(held))
        if options:
            _, _, group, self.centres, self.radii, self.bars, self.sizes = min(options, key=lambda o: o[:2])
        else:
            group, self.centres, self.radii, self.bars, self.sizes = np.empty(0, np.int64), np.empty((0, width)), np.empty(0), np.empty(0), np.empty(0)
        #: Group of each cell's queries; -1 where a cell has none.
        self.group = np.full(cells, -1)
        self.group[cell] = group


def needed(rows: DataFrame, plan: Plan) -> DataFrame:
    """(group, block, id, v): the rows that some query of a group may need, cell by cell and then row by row."""
    pivots, width = plan.pivots, plan.width
    centres, radii, bars = plan.centres, plan.radii, plan.bars

    def place(batches):
        for batch in slices(batches):
            x = matrix(batch.column(1).to_pylist(), width)
            cell = nearest(x, pivots)
            with np.errstate(over="ignore", invalid="ignore"):
                far = np.nan_to_num(np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1)), nan=np.inf)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), pa.array(far)], names=["id", "v", "cell", "far"])

    placed = staged(rows.select("id", "v").mapInArrow(place, "id long, v binary, cell int, far double"), "cells")
    radius = np.zeros(len(pivots))
    for r in placed.groupBy("cell").agg(F.max("far").alias("far")).collect():  # one row a pivot
        radius[r.cell] = r.far
    with np.errstate(over="ignore", invalid="ignore"):
        p_norm, c_norm = np.sqrt((pivots * pivots).sum(axis=1)), np.sqrt((centres * centres).sum(axis=1))
        bound = pivots @ centres.T + radius[:, None] * c_norm[None, :] + (p_norm + radius)[:, None] * radii[None, :]
        visited = reaches(bound + 1e-9 * (p_norm + radius)[:, None] * c_norm[None, :], bars[None, :])

    def send(batches):
        for batch in slices(batches):
            cell = batch.column(2).to_numpy()
            x = matrix(batch.column(1).to_pylist(), width)
            row, group = np.nonzero(visited[cell] & reaches(upper(x, centres, radii), bars[None, :]))
            taken = batch.select([0, 1]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), pa.array(group, pa.int32())], names=["id", "v", "group"])

    return placed.select("id", "v", "cell").mapInArrow(send, "id long, v binary, group int")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its k best other rows."""
    rows = staged(whole_vectors(vectors, scale, id_col, vector_col), "vectors")
    plan = Plan(rows, k, every)
    sent = staged(needed(rows, plan), "needed")
    counts = {r.group: r.n for r in sent.groupBy("group").agg(F.count("*").alias("n")).collect()}  # one row a group, of which there are no more than pivots
    groups = max(1, len(plan.sizes))
    block_rows = min(BLOCK_ROWS, max(1024, sum(counts.values()) // 64))
    blocks = [max(1, -(-counts.get(g, 0) // block_rows)) for g in range(groups)]
    chunks = [max(1, -(-int(plan.sizes[g]) // QUERY_ROWS)) if g < len(plan.sizes) else 1 for g in range(groups)]
    of = lambda values, group: F.get(F.array(*[F.lit(int(v)) for v in values]), group)
    width = plan.width
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    asked = plan.queries.withColumn("group", of(plan.group, F.col("cell"))).withColumn("chunk", F.pmod(F.xxhash64("id", "v"), of(chunks, F.col("group"))).cast("int"))
    asked = asked.withColumn("block", each(of(blocks, F.col("group")))).select("id", "v", "group", "block", "chunk")
    data = sent.withColumn("block", F.pmod(F.xxhash64("id", "v"), of(blocks, F.col("group"))).cast("int"))
    data = data.withColumn("chunk", each(of(chunks, F.col("group")))).select("id", "v", "group", "block", "chunk")

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("id", kind="stable")
            ids, x = right["id"].to_numpy(), matrix(right["v"], width)
            for start in range(0, len(left), 256):
                part = left.iloc[start : start + 256]
                for q, row in zip(part["id"].to_numpy(), products(matrix(part["v"], width), x), strict=True):
                    other = np.flatnonzero(ids != q)
                    out += [(q, ids[p], row[p]) for p in other[best(row[other], k)]]
        release()
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    keys = ["group", "block", "chunk"]
    found = asked.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(solve, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
