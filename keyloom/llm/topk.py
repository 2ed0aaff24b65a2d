"""Exact top-k by integer inner product, with a pivot table that eliminates candidates.

For vectors q and x, 2 q.x = |q|^2 + |x|^2 - |q - x|^2, and for every pivot p, |q - x| >= ||q - p| - |x - p||.  The
distances of all vectors to the pivots are computed once and written (the pivot table); with them go the vectors' norms
and their nearest pivot.  Vectors with one nearest pivot are dealt out in blocks, and a block knows the range of its
distances to every pivot, so one comparison with these ranges bounds all scores that a query can have in it.

A query first visits the block with the best bound, which gives it a k-th score.  Of the others it visits those whose
bound reaches that score.  Inside a block the same bounds hold for leaves of some rows; leaves are evaluated in the
order of their bounds, against a k-th score that keeps rising, until the next bound is below it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import batch, scratch, staged

PIVOTS, SCALE = 24, 64
#: Bytes of vectors in a block of rows and in a block of queries, which one task holds, and rows in a leaf.
ROW_BYTES, QUERY_BYTES, LEAF = 8 << 20, 2 << 20, 64
#: Queries and leaves that are evaluated together.
TILE, LEAVES = 64, 16
#: Vectors that the pivots are chosen from, at most; any choice gives the same results.
PIVOT_SAMPLE = 2048
#: Blocks whose ranges every task may hold (400 bytes each).  With more, queries visit all blocks and the leaves do the elimination.
MOST_RANGES = 1 << 16
#: The cell of vectors too large for exact arithmetic in double precision; they are evaluated as Python integers, all of them.
WILD = -1
#: Float columns written by search tasks: `over` orders scores outside 64 bits.
SCORED = pa.schema([("query", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("over", pa.binary())])
_SCORED_SQL = "query long, query_id long, vec_id long, score long, over binary"
_TABLE = pa.schema([("row", pa.int64()), ("vec_id", pa.int64()), ("is_query", pa.bool_()), ("dim", pa.int32()), ("cell", pa.int32()), ("norm", pa.float64()), ("near", pa.list_(pa.float64())), ("embedding", pa.list_(pa.float64()))])
_TABLE_SQL = "row long, vec_id long, is_query boolean, dim int, cell int, norm double, near array<double>, embedding array<double>"


def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null, and all components finite numbers."""
    return embedding.isNotNull() & F.coalesce(F.forall(embedding, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False))


# -- vectors ----------------------------------------------------------------------------------------------------


def quantised(flat: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors laid end to end -> their quantised components, and which of them are too large for exact sums in double precision."""
    with np.errstate(over="ignore"):
        out = np.floor(flat.astype(np.float64) * SCALE).reshape(-1, dim) if dim else np.zeros((0, 0))
    wild = np.abs(out).max(1, initial=0.0) >= (2.0**51 / max(1, dim)) ** 0.5
    return out, wild


def exact(row: np.ndarray) -> np.ndarray:
    """A vector's quantised components as Python integers."""
    return np.array([int(v) * SCALE if abs(v) >= 2.0**53 else int(np.floor(v * SCALE)) for v in row.tolist()] or [0], object)


def lists(column: pa.Array, at: np.ndarray, dim: int) -> np.ndarray:
    """The cells of a list column at some rows, all of one length, as a matrix."""
    return column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Vectors far from one another: each next pivot is the one farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of vectors to pivots; the squares are exact."""
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T, 0.0))


def pivot_table(vectors: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Rows (row, vec_id, is_query, dim, embedding) with their norms, distances to the pivots of their length, and cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            dims, embedding = rows.column("dim").to_numpy(), rows.column("embedding")
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                flat = lists(embedding, at, dim)
                x, wild = quantised(flat.ravel(), dim)
                x = np.where(wild[:, None], 0.0, x) if dim else np.zeros((len(at), 0))
                wild = wild if dim else np.zeros(len(at), bool)
                own = pivots.get(dim, np.zeros((0, dim)))
                near = to_pivots(x, own) if len(own) else np.zeros((len(at), 0))
                cell = np.where(wild, WILD, near.argmin(1) if near.shape[1] else 0).astype(np.int32)
                ends = np.arange(len(at) + 1, dtype=np.int32)
                made = {name: rows.column(name).take(pa.array(at)) for name in ("row", "vec_id", "is_query", "dim")}
                made |= {"cell": cell, "norm": (x * x).sum(1), "near": pa.ListArray.from_arrays(ends * near.shape[1], near.ravel()), "embedding": pa.ListArray.from_arrays(ends * dim, flat.astype(np.float64).ravel())}
                yield batch(made, _TABLE)

    return vectors.select("row", "vec_id", "is_query", "dim", "embedding").mapInArrow(run, _TABLE_SQL)


# -- bounds -----------------------------------------------------------------------------------------------------


@dataclass
class Ranges:
    """Blocks or leaves of vectors of one length: the least and greatest distance to each pivot, and the greatest norm."""

    low: np.ndarray
    high: np.ndarray
    most: np.ndarray

    def bounds(self, near: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """For each query (its distances to the pivots, its norm) and each block, no less than any score between them.

        Rounded up, so that no error of a square root can drop a candidate; infinite where a number is not finite.
        """
        gap = np.zeros((len(near), len(self.most)))
        for p in range(near.shape[1]):
            own = near[:, p : p + 1]
            np.maximum(gap, np.maximum(self.low[None, :, p] - own, own - self.high[None, :, p]), out=gap)
        both = norm[:, None] + self.most[None]
        out = (both - (np.maximum(gap, 0) * (1 - 1e-9)) ** 2) / 2 + 1e-6 * (1 + both)
        return np.where(np.isfinite(out), out, np.inf)


def leaves(near: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, Ranges, np.ndarray]:
    """Rows in an order in which neighbours have like distances, the ranges of its leaves, and where these begin."""
    if near.shape[1]:
        spread = near.std(0)
        order = np.lexsort((norm, near[:, spread.argmax()]))
    else:
        order = np.argsort(norm, kind="stable")
    starts = np.arange(0, len(norm), LEAF)
    near, norm = near[order], norm[order]
    return order, Ranges(np.minimum.reduceat(near, starts, 0), np.maximum.reduceat(near, starts, 0), np.maximum.reduceat(norm, starts)), starts


# -- evaluation -------------------------------------------------------------------------------------------------


@dataclass
class Side:
    """Vectors of one length in memory: what the pivot table says of them."""

    vectors: np.ndarray
    ids: np.ndarray
    near: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table, dim: int) -> Side:
        rows = rows.combine_chunks()
        x = rows.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), dim)
        near = rows.column("near").combine_chunks()
        return cls(x, rows.column("vec_id").to_numpy(), near.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(near.flatten()) // max(1, len(rows))), rows.column("norm").to_numpy())


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of hits (query, id, score), each query's k best; ties go to the smaller id."""
    order = np.lexsort((ids, -scores, query))
    query, ids, scores = query[order], ids[order], scores[order]
    first = np.searchsorted(query, query, "left")
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], scores[keep]


def search(asked: Side, rows: Side, k: int, floor: np.ndarray, evaluated: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best rows of a block (other ids than its own) that score at least its floor: query numbers, ids, scores.

    evaluated: a list that receives the number of scores computed.
    """
    queries, _ = quantised(asked.vectors.ravel(), asked.vectors.shape[1]) if asked.vectors.shape[1] else (asked.vectors, None)
    x, _ = quantised(rows.vectors.ravel(), rows.vectors.shape[1]) if rows.vectors.shape[1] else (rows.vectors, None)
    order, ranges, starts = leaves(rows.near, rows.norm)
    x, ids = x[order], rows.ids[order]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(queries), TILE):
        q, own = queries[a : a + TILE], asked.ids[a : a + TILE]
        bounds = ranges.bounds(asked.near[a : a + TILE], asked.norm[a : a + TILE])
        kth, top = floor[a : a + TILE].copy(), np.full((len(q), k), -np.inf)
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        by_bound = np.argsort(-bounds.max(0), kind="stable")
        for b in range(0, len(by_bound), LEAVES):
            group = np.sort(by_bound[b : b + LEAVES])
            alive = np.flatnonzero((bounds[:, group] >= kth[:, None]).any(1))
            if not len(alive):
                if not (bounds[:, by_bound[b:]].max(1) >= kth).any():
                    break  # no query's next bound reaches its k-th score
                continue
            at = (starts[group][:, None] + np.arange(LEAF)[None]).ravel()
            at = at[at < len(ids)]
            scores = q[alive] @ x[at].T
            if evaluated is not None:
                evaluated.append(scores.size)
            scores[own[alive][:, None] == ids[at][None]] = -np.inf
            hit = (scores >= kth[alive][:, None]) & (scores > -np.inf)
            some = np.flatnonzero(hit.any(1))
            if not len(some):
                continue
            i, j = np.nonzero(hit)
            hits.append((alive[i], ids[at][j], scores[i, j]))
            who = alive[some]
            top[who] = np.partition(np.concatenate([top[who], scores[some]], 1), -k, 1)[:, -k:]
            kth[who] = np.maximum(kth[who], top[who].min(1))
        if hits:
            query, found, scores = (np.concatenate(v) for v in zip(*hits, strict=True))
            keep = scores >= kth[query]
            query, found, scores = best(query[keep], found[keep], scores[keep], k)
            out.append((query + a, found, scores))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(v) for v in zip(*out, strict=True))


def search_exact(asked: Side, rows: Side, k: int) -> Iterator[tuple[int, list[int], list[int]]]:
    """The same for vectors of any size, in Python integers: query number, ids, scores."""
    x = [exact(v) for v in rows.vectors]
    ids = rows.ids.tolist()
    for n, (v, own) in enumerate(zip(asked.vectors, asked.ids.tolist(), strict=True)):
        q = exact(v)
        scored = sorted((-int(w @ q), i) for w, i in zip(x, ids, strict=True) if i != own)[:k]
        yield n, [i for _, i in scored], [-s for s, _ in scored]


def over(score: int) -> bytes:
    """A key whose order, as unsigned bytes, is that of scores outside 64 bits; all scores within have the same."""
    if -(2**63) <= score < 2**63:
        return b"\1"
    size = (abs(score).bit_length() + 7) // 8
    raw = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\2" + raw if score > 0 else b"\0" + bytes(255 - b for b in raw)


# -- tables -----------------------------------------------------------------------------------------------------


@dataclass
class Blocks:
    """How the rows are dealt out: of each length the number of blocks, which of them hold large vectors, and the ranges of all, if they are few."""

    count: dict[int, int]
    wild: dict[int, np.ndarray]
    ranges: dict[int, Ranges] | None = None

    def bounds(self, dim: int, near: np.ndarray, norm: np.ndarray, cell: np.ndarray) -> np.ndarray:
        n = self.count.get(dim, 0)
        if self.ranges is None:
            return np.full((len(norm), n), np.inf)
        out = self.ranges[dim].bounds(near, norm)
        out[:, self.wild[dim]] = np.inf
        out[cell == WILD] = np.inf
        return out


def blocks_of(table: DataFrame) -> tuple[Blocks, DataFrame]:
    """The blocks of a pivot table whose length has queries, and its rows with `block`; the driver holds a row for each length and cell, and one for each block of MOST_RANGES at most."""
    spark: SparkSession = table.sparkSession
    counts = table.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q")).collect()
    asked = {r["dim"] for r in counts if r["q"]}
    cells, count, wild = [], {}, {}
    for r in sorted((r for r in counts if r["dim"] in asked), key=lambda r: (r["dim"], r["cell"])):
        size = max(1, ROW_BYTES // (8 * max(1, r["dim"])))
        n, first = -(-r["n"] // size), count.get(r["dim"], 0)
        cells.append((r["dim"], r["cell"], first, n))
        count[r["dim"]] = first + n
        wild.setdefault(r["dim"], []).extend([r["cell"] == WILD] * n)
    dealt = F.broadcast(spark.createDataFrame(cells, "dim int, cell int, first int, blocks int"))  # a row for each length and cell
    rows = table.join(dealt, ["dim", "cell"]).withColumn("block", (F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks"))).cast("int")).drop("first", "blocks")
    found = Blocks(count, {d: np.array(w) for d, w in wild.items()})
    if sum(count.values()) <= MOST_RANGES:
        ends = [f(F.get("near", F.lit(p))).alias(f"{name}{p}") for name, f in (("low", F.min), ("high", F.max)) for p in range(PIVOTS)]
        each = rows.groupBy("dim", "block").agg(F.max("norm").alias("most"), *ends).toPandas()
        found.ranges = {}
        for dim, n in count.items():
            own = each[each["dim"] == dim].set_index("block").reindex(range(n))  # a block that got no row has nothing to give
            width = sum(own[f"low{p}"].notna().any() for p in range(PIVOTS))
            low, high = (own[[f"{name}{p}" for p in range(width)]].to_numpy(np.float64).reshape(n, width) for name in ("low", "high"))
            found.ranges[dim] = Ranges(np.nan_to_num(low), np.nan_to_num(high), own["most"].fillna(0.0).to_numpy(np.float64))
    return found, rows


def visits(queries: DataFrame, blocks: Blocks, first: bool) -> DataFrame:
    """Queries (the pivot table's rows with `floor` and `done`, a block visited already) -> row, block: the block of the best bound, or all others whose bound reaches the floor."""
    schema = pa.schema([("row", pa.int64()), ("dim", pa.int32()), ("block", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            dims = rows.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                many = max(1, (1 << 18) // max(1, blocks.count.get(dim, 0)))
                every = np.flatnonzero(dims == dim)
                for a in range(0, len(every), many):
                    at = every[a : a + many]
                    part = rows.take(pa.array(at))
                    near = part.column("near").flatten().to_numpy(zero_copy_only=False)
                    near = near.reshape(len(at), len(near) // len(at))
                    bounds = blocks.bounds(dim, near, part.column("norm").to_numpy(), part.column("cell").to_numpy())
                    if first:
                        i, j = np.arange(len(at)), bounds.argmax(1)
                    else:
                        want = bounds >= part.column("floor").to_numpy()[:, None]
                        want[np.arange(len(at)), part.column("done").to_numpy()] = False
                        i, j = np.nonzero(want)
                    yield batch({"row": part.column("row").to_numpy()[i], "dim": np.full(len(i), dim), "block": j}, schema)

    return queries.mapInArrow(run, "row long, dim int, block int")


def evaluate(asks: DataFrame, queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Visits (row, dim, block) of queries (the pivot table's rows with `floor`) to blocks -> what they find there, at most k rows a visit.

    A block that so many queries visit that a task would hold more than QUERY_BYTES of them is there several times, each
    time with some of them; one that no query visits is not read.
    """
    counts = asks.groupBy("dim", "block").agg(F.count("*").alias("visitors"))
    parts = counts.select("dim", "block", F.ceil(F.col("visitors") * F.greatest(F.col("dim"), F.lit(1)) * 8 / QUERY_BYTES).cast("int").alias("parts"))
    one = ["dim", "block", "part"]
    names = ["vec_id", "cell", "norm", "near", "embedding"]
    left = asks.join(queries.select("row", "floor", *names), "row").join(parts, ["dim", "block"]).withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts")).cast("int"))
    right = rows.select("dim", "block", *names).join(parts, ["dim", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return SCORED.empty_table()
        dim = left.column("dim")[0].as_py()
        numbers, floor = left.column("row").to_numpy(), left.column("floor").to_numpy()
        wild_rows, wild = right.column("cell")[0].as_py() == WILD, left.column("cell").to_numpy() == WILD
        asked, there = Side.of(left, dim), Side.of(right, dim)
        tables = []
        plain = np.zeros(0, np.int64) if wild_rows else np.flatnonzero(~wild)
        if len(plain):
            some = Side(asked.vectors[plain], asked.ids[plain], asked.near[plain], asked.norm[plain])
            query, ids, scores = search(some, there, k, floor[plain])
            query = plain[query]
            tables.append(pa.table({"query": numbers[query], "query_id": asked.ids[query], "vec_id": ids, "score": scores.astype(np.int64), "over": pa.array([b"\1"] * len(ids), pa.binary())}, schema=SCORED))
        large = np.arange(len(numbers)) if wild_rows else np.flatnonzero(wild)
        if len(large):
            some = Side(asked.vectors[large], asked.ids[large], asked.near[large], asked.norm[large])
            for n, ids, scores in search_exact(some, there, k):
                at = int(large[n])
                cut = [max(-(2**63), min(2**63 - 1, s)) for s in scores]
                tables.append(pa.table({"query": [int(numbers[at])] * len(ids), "query_id": [int(asked.ids[at])] * len(ids), "vec_id": ids, "score": cut, "over": [over(s) for s in scores]}, schema=SCORED))
        return pa.concat_tables(tables)

    left, right = (df.select(*[F.col(c).alias(c) for c in (*one, *more, *names)]) for df, more in ((left, ["row", "floor"]), (right, [])))  # two frames, not one joined with itself
    return left.groupBy(*one).cogroup(right.groupBy(*one)).applyInArrow(run, _SCORED_SQL)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """Rows (vec_id, embedding), the queries among them by a condition -> query_id, rank, vec_id, score.

    Defined cases: vectors that are null or hold null or non-finite components take no part, neither do rows with a
    null vec_id; vectors of different lengths never meet; empty vectors score 0 with one another; of rows with the same
    vec_id, each is a candidate (of all queries but those with its id) and each query gives its own ranks under its id;
    ties go to the smaller vec_id; scores outside 64 bits are ranked as they are and shown as the nearest 64-bit number;
    other columns are ignored; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    with scratch(spark):
        return staged(_top_k(vectors, is_query, k), "top-k", keep=True)


def _top_k(vectors: DataFrame, is_query: Column, k: int) -> DataFrame:
    spark = vectors.sparkSession
    kept = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("is_query"), F.size("embedding").alias("dim"))
    sample = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).select("dim", "embedding").toPandas()
    pivots = {}
    for dim, own in sample.groupby("dim")["embedding"]:
        x, wild = quantised(np.concatenate([np.asarray(v, np.float64) for v in own]), int(dim)) if dim else (np.zeros((0, 0)), np.zeros(0, bool))
        pivots[int(dim)] = choose_pivots(x[~wild])
    table = staged(pivot_table(kept.withColumn("row", F.monotonically_increasing_id()), pivots), "pivots")  # numbered once, as written
    blocks, rows = blocks_of(table)
    if not blocks.count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    queries = table.where("is_query").withColumn("floor", F.lit(float("-inf"))).withColumn("done", F.lit(-1))
    asks = staged(visits(queries, blocks, True), "visits")
    found = staged(evaluate(asks, queries, rows, k), "found")
    kth = found.groupBy(F.col("query").alias("row")).agg(F.count("*").alias("n"), F.min(F.struct("over", "score")).alias("least"))
    floor = F.when(F.col("n") >= k, F.when(F.col("least.over") == F.lit(b"\1"), F.col("least.score").cast("double")).when(F.col("least.over") > F.lit(b"\1"), F.lit(2.0**60)))
    first = asks.select("row", F.col("block").alias("done"))
    risen = table.where("is_query").join(first, "row").join(kth.select("row", floor.alias("floor")), "row", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    risen = staged(risen.select(*table.columns, "floor", "done"), "queries")
    more = evaluate(staged(visits(risen, blocks, False), "visits"), risen, rows, k)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("over"), F.desc("score"), "vec_id"))
    return found.unionAll(more).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
