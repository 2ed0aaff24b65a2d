"""Equal windows of many strings by a distributed difference-cover suffix sort, down to the depth of a window.

The strings lie in blocks, in the order of precedence, so that a block's number and a window's place in it tell which of
two windows comes first.  Each string has an anchor that lies at the same place in all windows that equal one another
(the minimiser), and positions are counted from it in symbols of a tenth of a window: the windows that begin at a symbol
of number 0, 1 or 2 modulo 3 are the three classes.

* Sampled triples: at positions of classes 1 and 2 that windows need, three symbols are a triple.  Each block sends its
  different triples to the task of their range, where all are sorted; a triple's name is its rank among all of them.
* Recursion on names: a window of class 1 or 2 is a string of names three symbols apart, which three of them and what
  they leave over cover; its order is that of the string of names.
* Remaining suffixes: a window of class 0 is a symbol and the names after it.
* All windows, so written, are sorted by range once more.  Windows that equal one another are neighbours now; each is
  compared with the one before, and all but the first of equal ones are repeats.

Anchored positions put equal windows into one class, so the orders of the classes lie one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, release, staged, tasks
from .near_dedup import mix

#: Bytes of strings in a block, and of keys that one task sorts at a time.
BLOCK_BYTES, RANGE_BYTES = 1 << 20, 8 << 20
#: Blocks that the borders of the ranges are drawn from, at most, and keys of each.
SAMPLE_BLOCKS, SAMPLE_KEYS = 64, 512
_FACTORS = np.random.default_rng(20).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

_BLOCK = pa.schema([("block", pa.int64()), *[(c, pa.list_(pa.int64())) for c in ("d", "k", "start", "n", "g")], ("body", pa.binary())])
_BLOCK_SQL = "block long, d array<long>, k array<long>, start array<long>, n array<long>, g array<long>, body binary"


def blocks_of(strings: DataFrame) -> DataFrame:
    """Strings (d, k, start, n windows, anchor g, body) -> blocks of them, numbered in the order of d, k and start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, made = 0, 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            lists = {c: pa.array([rows.column(c).to_numpy()], pa.list_(pa.int64())) for c in ("d", "k", "start", "n", "g")}
            return batch({"block": [TaskContext.get().partitionId() << 32 | made], "body": [b"".join(rows.column("body").to_pylist())]} | lists, _BLOCK)

        for rows in batches:
            while len(rows):
                total = np.cumsum(pa.compute.binary_length(rows.column("body")).to_numpy())
                cut = min(len(rows), int(np.searchsorted(total, BLOCK_BYTES - size)) + 1)
                held.append(rows.slice(0, cut))
                size += int(total[cut - 1])
                rows = rows.slice(cut)
                if size >= BLOCK_BYTES:
                    yield block()
                    held, size, made = [], 0, made + 1
        if held:
            yield block()

    order = ["d", "k", "start"]
    names = [*order, "n", "g", "body"]
    return strings.select(*names).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, _BLOCK_SQL)


def different(words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers, column by column -> the numbers of the first ones of the different rows, and for each row which of these it is like."""
    hashes = mix(sum((x * f for x, f in zip(words, _FACTORS, strict=False)), np.zeros(len(words[0]), np.uint64)))
    for order in (np.argsort(hashes), None):
        ranked = [hashes[order]] if order is not None else []
        if order is None:  # two rows share a hash
            order = np.lexsort(words)
            ranked = [x[order] for x in words]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for x in ranked:
            new[1:] |= x[1:] != x[:-1]
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        first = order[new]
        if all((x[first][inverse] == x).all() for x in words):
            break
    return first, inverse


def as_strings(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as fixed-width strings, which compare byte by byte."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel() if len(rows) else np.zeros(0, f"S{max(1, rows.shape[1])}")


def as_bytes(strings: np.ndarray, width: int) -> np.ndarray:
    return strings.astype(f"S{width}").view(np.uint8).reshape(len(strings), width)


def big_endian(numbers: np.ndarray) -> np.ndarray:
    """Numbers as rows of 8 bytes that compare like them."""
    return numbers.astype(">u8").view(np.uint8).reshape(len(numbers), 8)


class Windows:
    """A block's windows: where each begins, its class, and where the triples are whose names it needs."""

    def __init__(self, body: bytes, n: np.ndarray, g: np.ndarray, length: int):
        if length < 30:
            raise ValueError("a window has ten symbols of three bytes at least")
        self.length, self.w = length, length // 10
        self.flat = np.frombuffer(body, np.uint8)
        sizes = n + length - 1
        owner = np.repeat(np.arange(len(n)), n)
        self.offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        self.owner = owner
        self.at = (np.cumsum(sizes) - sizes)[owner] + self.offset
        self.kind = ((self.offset - g[owner]) // self.w) % 3
        steps = np.array([[1, 4, 7, -1], [0, 3, 6, 7], [0, 3, 6, -1]])[self.kind]
        self.needed = np.where(steps >= 0, self.at[:, None] + steps * self.w, len(self.flat))
        there = np.zeros(len(self.flat) + 1, bool)
        there[self.needed] = True
        there[-1] = False
        self.places = np.flatnonzero(there)
        self.number = np.cumsum(there) - 1  # of each needed place among them

    def bytes_at(self, at: np.ndarray, width: int) -> np.ndarray:
        return np.lib.stride_tricks.sliding_window_view(self.flat, width)[at]

    def triples(self) -> tuple[np.ndarray, np.ndarray]:
        """The different triples, and for each needed place the number of its triple."""
        width = 3 * self.w
        if not len(self.places):
            return np.zeros((0, width), np.uint8), np.zeros(0, np.int64)
        every = np.ndarray(len(self.flat) - 7, np.uint64, self.flat, strides=(1,))  # the 8 bytes from each place
        first, inverse = different([every[self.places + at] for at in (*range(0, width - 7, 8), *([width - 8] if width % 8 else []))])
        return self.bytes_at(self.places[first], width), inverse

    def keys(self, names: np.ndarray) -> np.ndarray:
        """The names of the needed places -> each window as bytes that equal, and sort, as windows of its class do."""
        w, tail = self.w, self.length - 10 * self.w
        own = np.append(names, 0)[self.number[self.needed]]
        out = np.zeros((len(self.at), 1 + max(24 + w, 32) + tail), np.uint8)
        out[:, 0] = self.kind
        for kind in range(3):
            i = np.flatnonzero(self.kind == kind)
            if not len(i):
                continue
            parts = [big_endian(own[i, j]) for j in range(4 if kind == 1 else 3)]
            if kind == 0:
                parts.insert(0, self.bytes_at(self.at[i], w))
            elif kind == 2:
                parts.append(self.bytes_at(self.at[i] + 9 * w, w))
            row = np.concatenate(parts, 1)
            out[i, 1 : 1 + row.shape[1]] = row
            if tail:
                out[i, -tail:] = self.bytes_at(self.at[i] + 10 * w, tail)
        return out


def borders(samples: list[np.ndarray], total: int, width: int) -> np.ndarray:
    """Sampled keys (rows of bytes), and how many bytes of keys there are -> the borders between ranges of about RANGE_BYTES."""
    found = np.sort(as_strings(np.concatenate(samples))) if samples else np.zeros(0, f"S{width}")
    ranges = max(1, -(-total // RANGE_BYTES))
    at = np.arange(1, ranges) * len(found) // ranges
    return np.unique(found[at]) if len(found) else found


def dealt(keys: np.ndarray, limits: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Keys by range: the range and the numbers of the keys in it."""
    owner = np.searchsorted(limits, as_strings(keys), side="right")
    order = np.argsort(owner, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(owner[order])) + 1) if len(order) else ():
        yield int(owner[own[0]]), own


@dataclass
class Row:
    """A block as it comes into a task."""

    block: int
    windows: Windows
    named: list[dict] | None


def block_rows(rows: pa.RecordBatch, length: int) -> Iterator[Row]:
    named = rows.column("named").to_pylist() if "named" in rows.schema.names else [None] * len(rows)
    for i, own in enumerate(named):
        n, g = (rows.column(c)[i].values.to_numpy() for c in ("n", "g"))
        yield Row(rows.column("block")[i].as_py(), Windows(rows.column("body")[i].as_py(), n, g, length), own)


_SENT = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("places", pa.binary())])
_SENT_SQL = "range int, block long, keys binary, places binary"
_SAMPLED = pa.schema([("keys", pa.binary()), ("total", pa.int64())])


def window_keys(row: Row, limits: np.ndarray, before: list[int]) -> np.ndarray:
    """A block with its triples' ranks in their ranges -> the keys of its windows."""
    triples, inverse = row.windows.triples()
    names = np.zeros(len(triples), np.int64)
    ranks = {x["range"]: np.frombuffer(x["ranks"], np.uint32) for x in row.named}
    for r, own in dealt(triples, limits):
        names[own] = ranks[r].astype(np.int64) + before[r]
    return row.windows.keys(names[inverse])


def sampled(blocks: DataFrame, make, fraction: int, width: int) -> np.ndarray:
    """The borders of the ranges of what `make` gives of each block, from one block in `fraction`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for keys in make(rows):
                step = max(1, len(keys) // SAMPLE_KEYS)
                yield batch({"keys": [keys[::step].tobytes()], "total": [keys.size]}, _SAMPLED)

    found = blocks.where(F.pmod(F.xxhash64("block"), F.lit(fraction)) == 0).mapInArrow(run, "keys binary, total long").collect()  # some SAMPLE_BLOCKS rows
    return borders([np.frombuffer(r["keys"], np.uint8).reshape(-1, width) for r in found if r["keys"]], sum(r["total"] for r in found) * fraction, width)


def by_range(sent: DataFrame) -> DataFrame:
    """Keys together with those of their range, range after range."""
    return sent.repartition(tasks(sent.sparkSession), "range").sortWithinPartitions("range")


def ranges_in(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[pa.RecordBatch]]]:
    """Batches sorted by range -> each range with its parts, as they come."""
    parts = ((r, rows.slice(a, b - a)) for rows in batches for r, a, b in _groups(rows))
    ahead = next(parts, None)
    while ahead is not None:
        current = ahead[0]

        def own() -> Iterator[pa.RecordBatch]:
            nonlocal ahead
            while ahead is not None and ahead[0] == current:  # noqa: B023
                yield ahead[1]
                ahead = next(parts, None)

        yield current, own()


def _groups(rows: pa.RecordBatch) -> Iterator[tuple[int, int, int]]:
    r = rows.column("range").to_numpy()
    edges = [0, *(np.flatnonzero(np.diff(r)) + 1).tolist(), len(r)]
    yield from ((int(r[a]), a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


_NAMED = pa.schema([("range", pa.int32()), ("block", pa.int64()), ("ranks", pa.binary()), ("different", pa.int64())])


def named(sent: DataFrame, width: int) -> DataFrame:
    """Triples by range -> for each block and range the ranks of the triples it sent, in their order, and how many the range has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, parts in ranges_in(batches):
            rows = pa.Table.from_batches(list(parts)).combine_chunks()
            blobs = [np.frombuffer(x.as_buffer(), np.uint8).reshape(-1, width) for x in rows.column("keys")]
            found, inverse = np.unique(as_strings(np.concatenate(blobs)), return_inverse=True)
            cuts = np.cumsum([len(x) for x in blobs])[:-1]
            ranks = [x.astype(np.uint32).tobytes() for x in np.split(inverse, cuts)]
            yield batch({"range": [r] * len(blobs), "block": rows.column("block").combine_chunks(), "ranks": ranks, "different": [len(found)] * len(blobs)}, _NAMED)

    return by_range(sent).mapInArrow(run, "range int, block long, ranks binary, different long")


_AGAIN = pa.schema([("block", pa.int64()), ("places", pa.binary())])


def repeated(sent: DataFrame, width: int) -> DataFrame:
    """Windows by range -> block and places of those that equal an earlier one.

    A range's windows are sorted and compared with their neighbours as often as RANGE_BYTES of them have come, and only
    the first of equal ones stays, so a task holds no more than the different ones of a range and what has come since.
    """

    def settle(keys: np.ndarray, block: np.ndarray, place: np.ndarray):
        order = np.lexsort((place, block, keys))
        keys, block, place = keys[order], block[order], place[order]
        same = np.append(False, keys[1:] == keys[:-1])
        return (keys[~same], block[~same], place[~same]), (block[same], place[same])

    def told(block: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        order = np.lexsort((place, block))
        block, place = block[order], place[order]
        cuts = np.flatnonzero(np.diff(block)) + 1
        return batch({"block": block[np.append(0, cuts)], "places": [x.astype(np.uint32).tobytes() for x in np.split(place, cuts)]}, _AGAIN)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in ranges_in(batches):
            held, size = [], 0
            first = True

            def flush():
                nonlocal held
                left, gone = settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = [left]
                return gone

            for rows in parts:
                for keys, block, places in zip(rows.column("keys"), rows.column("block").to_pylist(), rows.column("places"), strict=True):
                    own = np.frombuffer(places.as_buffer(), np.uint32).astype(np.int64)
                    held.append((as_strings(np.frombuffer(keys.as_buffer(), np.uint8).reshape(-1, width)), np.full(len(own), block), own))
                    size += len(own) * width
                    if size > RANGE_BYTES * (1 if first else 2):
                        gone = flush()
                        size, first = len(held[0][0]) * width, False
                        if len(gone[0]):
                            yield told(*gone)
            if held:
                gone = flush()
                if len(gone[0]):
                    yield told(*gone)

    return by_range(sent).mapInArrow(run, "block long, places binary")


def repeated_windows(strings: DataFrame, length: int) -> DataFrame:
    """Strings (d, k, start, n windows, anchor g, body) -> spans (d, k, start, stop) of windows that equal one that comes before by d, k and place."""
    spark = strings.sparkSession
    blocks = staged(blocks_of(strings), "blocks")
    fraction = max(1, blocks.count() // SAMPLE_BLOCKS)
    width = 3 * (length // 10)
    key_width = 1 + max(24 + length // 10, 32) + length - 10 * (length // 10)

    def triples_of(rows: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (row.windows.triples()[0] for row in block_rows(rows, length))

    limits = sampled(blocks, triples_of, fraction, width)

    def send_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in block_rows(rows, length):
                triples, _ = row.windows.triples()
                parts = [(r, triples[own].tobytes()) for r, own in dealt(triples, limits)]
                yield batch({"range": [r for r, _ in parts], "block": [row.block] * len(parts), "keys": [x for _, x in parts], "places": [None] * len(parts)}, _SENT)

    ranks = staged(named(blocks.mapInArrow(send_triples, _SENT_SQL), width), "ranks")
    release(spark)
    sizes = {r["range"]: r["n"] for r in ranks.groupBy("range").agg(F.max("different").alias("n")).collect()}  # one row a range
    before = np.concatenate([[0], np.cumsum([sizes.get(r, 0) for r in range(len(limits) + 1)])]).tolist()
    known = blocks.join(ranks.groupBy("block").agg(F.collect_list(F.struct("range", "ranks")).alias("named")), "block")

    def keys_of(rows: pa.RecordBatch) -> Iterator[np.ndarray]:
        return (window_keys(row, limits, before) for row in block_rows(rows, length))

    key_limits = sampled(known, keys_of, fraction, key_width)

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in block_rows(rows, length):
                keys = window_keys(row, limits, before)
                parts = [(r, keys[own].tobytes(), own.astype(np.uint32).tobytes()) for r, own in dealt(keys, key_limits)]
                yield batch({"range": [r for r, *_ in parts], "block": [row.block] * len(parts), "keys": [x for _, x, _ in parts], "places": [x for *_, x in parts]}, _SENT)

    again = staged(repeated(known.mapInArrow(send_windows, _SENT_SQL), key_width), "again")
    spans = pa.schema([(c, pa.int64()) for c in ("d", "k", "start", "stop")])

    def spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(len(rows)):
                d, k, start, n = (rows.column(c)[i].values.to_numpy() for c in ("d", "k", "start", "n"))
                gone = np.zeros(int(n.sum()), bool)
                for places in rows.column("again")[i].as_py():
                    gone[np.frombuffer(places, np.uint32)] = True
                owner = np.repeat(np.arange(len(n)), n)
                offset = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
                new = gone & ~(np.append(False, gone[:-1]) & (offset > 0))
                last = gone & ~(np.append(gone[1:], False) & np.append(offset[1:] > 0, False))
                a, b = np.flatnonzero(new), np.flatnonzero(last)
                own = owner[a]
                yield batch({"d": d[own], "k": k[own], "start": start[own] + offset[a], "stop": start[own] + offset[b] + length}, spans)

    meta = blocks.select("block", "d", "k", "start", "n")
    return meta.join(again.groupBy("block").agg(F.collect_list("places").alias("again")), "block").mapInArrow(spans_of, "d long, k long, start long, stop long")
