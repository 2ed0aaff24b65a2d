"""Exact removal of repeated passages: every byte in a string of `length` bytes that also starts earlier goes.

A suffix sort of a corpus moves several times its size.  Exact reductions come first:

* Documents whose text another one has already are repeats as a whole.
* Each window of `length` bytes has a minimiser: the leftmost of its GRAM-byte strings with the least hash.  Equal
  windows have equal minimisers at equal places, so windows whose minimiser is nowhere else are unique.  Windows with
  the same minimiser are neighbours in the text and form one string.
* Of equal strings all but the first are repeats.  A minimiser that has one string left is settled with that.

The strings that are left, of which others hold the same minimiser, are cut once more by longer minimisers (FINE_GRAM),
which leaves less of their edges.  The windows of what is left then are sorted by a distributed difference-cover
algorithm (suffix_order) and compared with their neighbours.

Texts and strings are told apart by hashes of 64 and 128 bits, windows byte by byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, fresh, release, scratch, slices, staged, tasks, text_slices, unstage, utf8
from .graph import counted, unique_join
from .near_dedup import _BYTE_VALUES, _powers, mix
from .suffix_order import repeated_windows

LENGTH, GRAM, FINE_GRAM = 100, 32, 64
#: Bytes of text indexed at a time, and of text cut into strings at a time.
INDEX_BYTES, CUT_BYTES = 1 << 20, 4 << 20
#: Whole copies whose numbers may be broadcast.
BROADCAST_ROWS = 1 << 20
NO_ID = -(2**63)
_VALUES = _BYTE_VALUES.copy()
_VALUES[65:91] = np.random.default_rng(7).integers(1, 1 << 63, 26, dtype=np.uint64)  # here A is not a
_U = np.uint64


def gram_hashes(flat: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes from each position that has so many."""
    up, down = _powers(len(flat))
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_VALUES[flat] * up[: len(flat)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: len(flat) - size + 1])


#: Bits of a place among the hashes that are compared at a time; the other bits of a hash decide, in every batch the same ones.
_PLACE_BITS = 20
_PLACES = _U((1 << _PLACE_BITS) - 1)


def leftmost_least(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` neighbouring hashes the place of the least one, by its upper bits, the leftmost of equal ones."""
    out = np.empty(len(hashes) - width + 1, np.int64)
    step = (1 << _PLACE_BITS) - width
    for a in range(0, len(out), step):
        part = hashes[a : a + step + width - 1]
        low = part & ~_PLACES | np.arange(len(part), dtype=np.uint64)
        have = 1
        while have < width:
            more = min(have, width - have)
            low = np.minimum(low[:-more], low[more:])
            have += more
        out[a : a + step] = (low & _PLACES).astype(np.int64) + a
    return out


def minimisers(flat: np.ndarray, ends: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Texts laid end to end -> runs of windows with one minimiser: first and last window, the minimiser's place, its hash.

    A run lies in one text.
    """
    n = len(flat)
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),)
    if n < length:
        return none
    hashes = gram_hashes(flat, gram)
    place = leftmost_least(hashes, length - gram + 1)  # of windows from 0 to n - length
    window = np.flatnonzero(np.arange(len(place)) + length <= np.repeat(ends, np.diff(ends, prepend=0))[: len(place)])
    if not len(window):
        return none
    at = place[window]
    new = np.append(True, (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1))
    first = window[new]
    last = np.append(window[np.flatnonzero(new)[1:] - 1], window[-1])
    return first, last, at[new], hashes[at[new]]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id and text (null: empty) with a key: the id (null: least) and a hash of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("k"), text.alias("text"))


_INDEX = pa.schema([("d", pa.int64()), ("k", pa.int64()), ("runs", pa.list_(pa.int64())), ("hashes", pa.list_(pa.int64()))])
#: In a packed run: bits of the number of windows, and of the place of the minimiser from the first of them.
_BITS = 12


def packed(first: np.ndarray, last: np.ndarray, place: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Runs as one number each: the first window's place in its text, the number of windows, and the minimiser's place from the first."""
    return (first - begin) << (2 * _BITS) | (last - first + 1) << _BITS | (place - first)


def unpacked(run: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low = (1 << _BITS) - 1
    return run >> (2 * _BITS), run >> _BITS & low, run & low


def index(docs: DataFrame, length: int) -> DataFrame:
    """Keyed documents -> their runs of windows, packed, and the minimisers' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, texts in text_slices(rows.column("text"), INDEX_BYTES):
                raw = utf8(texts)
                flat = np.frombuffer(b"".join(raw), np.uint8)
                ends = np.cumsum([len(r) for r in raw])
                first, last, place, hashes = minimisers(flat, ends, length)
                text = np.searchsorted(ends, first, side="right")
                runs = packed(first, last, place, (ends - np.diff(ends, prepend=0))[text])
                offsets = np.searchsorted(text, np.arange(b - a + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.view(np.int64))) for x in (runs, hashes)]
                yield pa.RecordBatch.from_arrays([rows.column("d").slice(a, b - a), rows.column("k").slice(a, b - a), *lists], schema=_INDEX)

    return docs.select("d", "k", "text").mapInArrow(run, "d long, k long, runs array<long>, hashes array<long>")


_PART = pa.schema([("hash", pa.int64()), ("key", pa.binary()), ("d", pa.int64()), ("k", pa.int64()), ("start", pa.int64()), ("n", pa.int64()), ("g", pa.int64()), ("body", pa.binary())])
_PART_SQL = "hash long, key binary, d long, k long, start long, n long, g long, body binary"


class _Parts:
    """Collects the strings of one batch; one that equals an earlier one of the batch is a repeat already and goes without key and body."""

    def __init__(self, length: int):
        self.length = length
        self.seen: set[bytes] = set()
        self.rows: list[tuple] = []

    def add(self, body: bytes, place: int, d: int, k: int, start: int, n: int, g: int, gram_hash: int) -> None:
        string = body[place : place + n + self.length - 1]
        if string not in self.seen:
            self.seen.add(string)
            self.rows.append((gram_hash, hashlib.blake2b(string, digest_size=16).digest(), d, k, start, n, g, string))
        elif self.rows and (before := self.rows[-1])[1] is None and before[2:5] == (d, k, start - before[5]):
            self.rows[-1] = (*before[:5], before[5] + n, *before[6:])  # goes on where the repeat before it ends
        else:
            self.rows.append((gram_hash, None, d, k, start, n, g, None))

    def result(self) -> pa.RecordBatch:
        return batch(dict(zip(_PART.names, zip(*self.rows, strict=True) if self.rows else [[]] * len(_PART), strict=True)), _PART)


def strings(texts: DataFrame, length: int) -> DataFrame:
    """Keyed documents with `found`, their runs (run, hash) whose minimiser recurs -> strings: minimiser's hash, key, document, place, windows, anchor, body."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = rows.column("found")
            own, (runs, hashes) = found.value_lengths().to_numpy(), (found.flatten().field(c).to_numpy(zero_copy_only=False) for c in range(2))
            d, k = rows.column("d").to_numpy(), rows.column("k").to_numpy()
            upto = np.cumsum(own)
            for a, b, texts in text_slices(rows.column("text"), CUT_BYTES):
                raw, parts = utf8(texts), _Parts(length)
                cut = slice(upto[a] - own[a], upto[b - 1])
                doc = np.repeat(np.arange(a, b), own[a:b])
                start, n, g = unpacked(runs[cut])
                order = np.lexsort((start, k[doc], d[doc]))
                for i, at, size, place, h in zip(doc[order].tolist(), start[order].tolist(), n[order].tolist(), g[order].tolist(), hashes[cut][order].tolist(), strict=True):
                    parts.add(raw[i - a], at, int(d[i]), int(k[i]), at, size, place, h)
                yield parts.result()

    return texts.select("d", "k", "text", "found").mapInArrow(run, _PART_SQL)


def finer(open_strings: DataFrame, length: int, gram: int) -> DataFrame:
    """Strings -> the strings that minimisers of `gram` bytes cut them into, like strings()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            order = np.lexsort([rows.column(c).to_numpy() for c in ("start", "k", "d")])  # the first of a batch is to be the first of its like
            rows = rows.take(pa.array(order))
            raw = rows.column("body").to_pylist()
            d, k, start = (rows.column(c).to_pylist() for c in ("d", "k", "start"))
            for a, b in slices(map(len, raw), INDEX_BYTES):
                parts = _Parts(length)
                ends = np.cumsum([len(x) for x in raw[a:b]])
                first, last, place, hashes = minimisers(np.frombuffer(b"".join(raw[a:b]), np.uint8), ends, length, gram)
                of = np.searchsorted(ends, first, side="right")
                at = first - (ends - np.diff(ends, prepend=0))[of]
                for i, x, n, g, h in zip((of + a).tolist(), at.tolist(), (last - first + 1).tolist(), (place - first).tolist(), hashes.view(np.int64).tolist(), strict=True):
                    parts.add(raw[i], x, d[i], k[i], start[i] + x, n, g, h)
                yield parts.result()

    return open_strings.select("d", "k", "start", "body").mapInArrow(run, _PART_SQL)


def settled(parts: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Strings -> spans (d, k, start, stop) of those that equal an earlier one, and the first ones of minimisers that have several.

    No key gathers rows: firsts and counts are minima and sums that combine before they meet, and a string that is in
    many places is dealt out.
    """
    span = ["d", "k", "start", (F.col("start") + F.col("n") + (length - 1)).alias("stop")]
    known = parts.where(F.col("key").isNotNull())
    firsts = staged(known.groupBy("key").agg(F.min(F.struct("d", "k", "start")).alias("first"), F.count("*").alias("n"), F.any_value("hash").alias("hash")), "firsts")
    several = firsts.groupBy("hash").agg(F.count("*").alias("kinds")).where("kinds > 1").select("hash", F.lit(True).alias("open"))
    info = firsts.join(several.hint("shuffle_hash"), "hash", "left").where((F.col("n") > 1) | F.col("open")).select("key", "first", "open")
    met = unique_join(known, info, "key", firsts.where("n > 1").select("key", "n"), hint="shuffle_hash")
    own = F.struct("d", "k", "start") == F.col("first")
    done = staged(met.where(~own | F.col("open")).select("hash", "d", "k", "start", "n", "g", F.when(own, F.col("body")).alias("body")), "settled")
    repeats = done.where("body is null").select(*span).unionAll(parts.where(F.col("key").isNull()).select(*span))
    return repeats, done.where("body is not null")


def repeated_rows(rows: DataFrame, *names: str) -> DataFrame:
    """Keys of documents (d and k by default) that several rows have."""
    return counted(rows.select(F.struct(*(names or ("d", "k"))).alias("key")), "key").where("n > 1")


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Documents (doc_id, text) -> d, k and `spans`, the repeated spans of each keyed document that has any."""
    with scratch(docs.sparkSession):
        return _repeated_spans(docs, length)


def _repeated_spans(docs: DataFrame, length: int) -> DataFrame:
    spark = docs.sparkSession
    own = keyed(docs)
    same = own.select("d", "k", F.md5("text").alias("text_md5"), F.octet_length("text").alias("n"))
    firsts = staged(same.groupBy("text_md5").agg(F.min(F.struct("d", "k")).alias("first"), F.count("*").alias("n_rows")).where("n_rows > 1"), "firsts")
    weights = firsts.select("text_md5", F.col("n_rows").alias("n"))
    copies = staged(unique_join(same, firsts.select("text_md5", "first"), "text_md5", weights).where("d <> first.d or k <> first.k").select("d", "k", "n").distinct(), "copies")
    runs = staged(index(own, length).withColumn("row", F.monotonically_increasing_id()), "index")  # numbered once, as written
    gone = runs.select("row", "d", "k").join(copies, ["d", "k"]).select("row")
    once = runs.join(F.broadcast(gone) if copies.count() <= BROADCAST_ROWS else gone, "row", "left_anti")  # 8 bytes a row
    flat = once.select("row", F.explode(F.arrays_zip("runs", "hashes")).alias("r")).select("row", F.col("r.runs").alias("run"), F.col("r.hashes").alias("hash"))
    again = staged(flat.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "recurring")
    release(spark)
    met = unique_join(flat, again.select("hash"), "hash", again, hint="shuffle_hash")
    found = staged(met.groupBy("row").agg(F.collect_list(F.struct("run", "hash")).alias("found")).join(runs.select("row", "d", "k"), "row").select("d", "k", "found"), "found")
    del met, flat, once, gone
    unstage(runs)
    release(spark)
    if not repeated_rows(found).isEmpty():  # repeated rows are one document; in place, as the join has dealt out by d and k
        once = own.join(found.dropDuplicates(["d", "k"]), ["d", "k"]).dropDuplicates(["d", "k"])
    else:
        once = own.join(found, ["d", "k"])
    coarse = staged(strings(once, length), "strings")
    unstage(found)
    release(spark)
    whole, left = settled(coarse, length)
    fine = staged(finer(left, length, FINE_GRAM), "fine")
    edges, left = settled(fine, length)
    release(spark)
    parts = [whole, edges, repeated_windows(left, length), copies.where(F.col("n") >= length).select("d", "k", F.lit(0).cast("long").alias("start"), F.col("n").cast("long").alias("stop"))]
    spans = parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])
    return staged(spans.groupBy("d", "k").agg(F.collect_list(F.struct("start", "stop")).alias("spans")), "spans", keep=True)


def merged(spans: list[dict], n: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    out: list[tuple[int, int]] = []
    for x in sorted((s["start"], min(n, s["stop"])) for s in spans):
        if out and x[0] <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], x[1])
        else:
            out.append(x)
    return out


_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def kept_bytes(raw: bytes, runs: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in runs:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def with_spans(docs: DataFrame, length: int) -> tuple[DataFrame, str]:
    """docs (all columns) with a column of spans, and its name; of rows that share id and text, all but one repeat as a whole."""
    d, k, name, salt, nth, least = fresh(docs, "_d", "_k", "_spans", "_salt", "_nth", "_least")
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = repeated_spans(docs, length).select(F.col("d").alias(d), F.col("k").alias(k), F.col("spans").alias(name))
    out = docs.withColumn(d, F.coalesce("doc_id", F.lit(NO_ID))).withColumn(k, F.xxhash64(text))
    if not repeated_rows(out, d, k).isEmpty():
        # the first of each part of a key's rows, then the first of those: no task gets all rows of a key
        out = out.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(tasks(docs.sparkSession))).cast("int"))
        out = out.withColumn(nth, F.row_number().over(Window.partitionBy(d, k, salt).orderBy(F.lit(0))))
        among = F.when(F.col(nth) == 1, F.lit(-1)).otherwise(F.col(salt))
        out = out.withColumn(least, among).withColumn(nth, F.row_number().over(Window.partitionBy(d, k, least).orderBy(salt)))
        out = out.withColumn(nth, F.when((F.col(least) == -1) & (F.col(nth) == 1), F.lit(1)).otherwise(F.lit(2))).drop(salt, least)
        whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.octet_length(text).cast("long").alias("stop")))
        out = out.join(spans, [d, k], "left").withColumn(name, F.when((F.col(nth) > 1) & (F.octet_length(text) >= length), whole).otherwise(F.col(name))).drop(nth)
    else:
        out = out.join(spans, [d, k], "left")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], name), name


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per document.

    A byte goes if it is in a string of `length` bytes that also starts earlier, in a document of a smaller id or in
    the same document, in the texts as given; matches never cross documents.  Defined cases: a null text is empty; texts
    shorter than `length` stay; a null doc_id comes first; rows that share a doc_id are documents in the order of a hash
    of their texts, and of equal ones all but one go; other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {name: [] for name in _RESULT.names[1:]}
            for text, spans in zip(rows.column("text"), rows.column(column).to_pylist(), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                runs = merged(spans or [], len(raw))
                kept = kept_bytes(raw, runs)
                for name, x in zip(_RESULT.names[1:], (len(raw), len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest()), strict=True):
                    out[name].append(x)
            yield batch({"doc_id": rows.column("doc_id")} | out, _RESULT)

    found, column = with_spans(docs.select("doc_id", "text"), length)
    return found.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes out of `text`, all rows and columns kept, whatever their names; n_chars, where there is one, follows.

    Characters that lose some of their bytes go as a whole.  Defined cases are those of dedup, but that a null text stays
    null.
    """

    @F.pandas_udf("string")
    def kept(texts, spans):
        import pandas as pd

        out = []
        for text, own in zip(texts, spans, strict=True):
            if text is None or own is None:
                out.append(text)
            else:
                raw = text.encode("utf-8", "replace")
                out.append(kept_bytes(raw, merged([{"start": s["start"], "stop": s["stop"]} for s in own], len(raw))).decode("utf-8", "ignore"))
        return pd.Series(out, dtype=object)

    found, name = with_spans(docs, length)
    out = found.withColumn("text", kept("text", F.col(name))).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
