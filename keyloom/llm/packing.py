"""Best-fit packing by minimum bin slack over the histogram of lengths.

A bin's content depends on lengths alone, so the search runs on the count of items of each length (at most `capacity`
numbers, whatever the size of the corpus).  Per bin, the longest length left seeds it, and a bitset subset-sum over the
lengths left finds the fullest combination that fits; the combination is then taken out, as often as the counts allow.
Items learn their bin from their rank among the items of their length, which is a prefix sum over partitions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import CHUNK_BYTES, batch, slices, staged

CAPACITY = 2048
PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("nth", pa.int64())])
PACKED = pa.schema([*[f for f in PIECE if f.name not in ("part", "nth")], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def fullest(counts: np.ndarray, seed: int, capacity: int) -> list[int]:
    """The lengths, seed first, of a fullest bin that holds one item of length seed.

    Bit s of the set means that some choice of the lengths so far sums to s.  Lengths join from the longest down, each
    up to its count by doubling; `steps` remembers the set before each join, from which the choice is read back.
    """
    room = capacity - seed
    if not room:
        return [seed]
    have = np.flatnonzero(counts[: room + 1])[::-1]
    full, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in have.tolist():
        left = min(int(counts[length]) - (length == seed), room // length)
        take = 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, [seed]
    for length, take, before in reversed(steps):
        if not before >> at & 1:
            at -= length * take
            out += [length] * take
    return out


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> dict[int, tuple[np.ndarray, ...]]:
    """counts[length] -> for each length, where its items go.

    Of each length: ranks (the first rank of each run), first (the run's first sequence), per (items of this length in
    each of the run's sequences) and offset (of the first of them).  Sequences are numbered from 0.
    """
    counts = counts.astype(np.int64).copy()
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used = np.zeros_like(counts)
    sequence = 0
    while len(alive := np.flatnonzero(counts)):
        chosen = fullest(counts, int(alive[-1]), capacity)
        lengths, each = np.unique(chosen, return_counts=True)
        times = int((counts[lengths] // each).min())
        offset = 0
        for length, per in zip(lengths.tolist(), each.tolist(), strict=True):
            runs.setdefault(length, []).append((int(used[length]), sequence, per, offset))
            used[length] += per * times
            offset += per * length
        counts[lengths] -= each * times
        sequence += times
    return {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in runs.items()}


def place(runs: dict[int, tuple[np.ndarray, ...]], length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sequence and offset of the items with these lengths and ranks."""
    sequence, offset = np.empty_like(rank), np.empty_like(rank)
    order = np.argsort(length, kind="stable")
    edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = order[a:b]
        n = int(length[own[0]])
        first, sequences, per, offsets = runs[n]
        k = np.searchsorted(first, rank[own], side="right") - 1
        nth, within = np.divmod(rank[own] - first[k], per[k])
        sequence[own], offset[own] = sequences[k] + nth, offsets[k] + within * n
    return sequence, offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, text) -> the pieces of each document, with `nth` among those of its length in partition `part`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = tokens.encoder(tokenizer).ids, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows in batches:
            ids, texts = rows.column("doc_id").to_pylist(), [x or "" for x in rows.column("text").to_pylist()]
            for a, b in slices(map(len, texts), CHUNK_BYTES):
                out: dict[str, list] = {k: [] for k in PIECE.names}
                for doc, text in zip(ids[a:b], texts[a:b], strict=True):
                    found = encode(text).tobytes() + bytes(4)
                    n = len(found) // 4
                    start, piece = 0, 0
                    while start < n:
                        length = (n - start) % capacity or capacity
                        for name, x in zip(PIECE.names, (doc, piece, start, length, zlib.crc32(found[4 * start : 4 * (start + length)]), part, int(seen[length])), strict=True):
                            out[name].append(x)
                        seen[length] += 1
                        start, piece = start + length, piece + 1
                yield batch(out, PIECE)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """Rows (doc_id, text) -> one row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Defined cases: a null or empty text is the one id 0; a null doc_id stays null; rows that share a doc_id are each
    packed; other columns are ignored; an empty table gives no rows.  The driver holds one count per length; a
    partition's counts never leave the executors.
    """
    cut = staged(pieces(docs, tokenizer, capacity), "pieces")
    each = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    total = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in total.items():
        counts[length] = n
    runs = plan(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = each.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    ranked = cut.join(base, ["part", "length"]).withColumn("nth", F.col("nth") + F.col("before")).select(*PIECE.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            columns = {name: rows.column(name) for name in PIECE.names}
            sequence, offset = place(runs, columns["length"].to_numpy(), columns["nth"].to_numpy())
            yield batch(columns | {"sequence_id": sequence, "offset": offset}, PACKED)

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
