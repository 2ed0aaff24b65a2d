"""Near-duplicate classes by min-max hashing.

A permutation of the shingles gives two values, its minimum and its maximum, so a signature of 2k values takes k hash
evaluations per shingle, and both values agree between two sets with the probability of their similarity.  Three
permutations, six values, make a band; documents that agree in a band are candidates, and every link is confirmed on
the full sets.

Candidates are not expanded into pairs.  Equal sets are one class from the start.  In a bucket all members are compared
with one pivot, the member with the most neighbours over all its buckets.  Only in buckets that then still hold several
components, the members of the smaller ones are compared with all others of the bucket, block by block.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, scratch, staged, text_slices
from .graph import components, counted, sieved, unique_join

#: Permutations in a band (twice as many values), and the chance that a pair at the threshold shares no band.
PER_BAND, MISS = 3, 1e-5
SEED = 20240229
#: Text whose shingles a Python worker hashes at a time, in bytes; a longer text comes alone.
SHINGLE_BYTES = 1 << 18
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACES = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE_VALUES = np.random.default_rng(SEED).integers(1, 1 << 63, 256, dtype=np.uint64)
_BYTE_VALUES[65:91] = _BYTE_VALUES[97:123]  # A-Z count as a-z


def bands_for(percent: int) -> int:
    """Bands that miss a pair of this similarity with a chance of MISS at most."""
    return math.ceil(math.log(MISS) / math.log(1 - (percent / 100) ** (2 * PER_BAND)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the odd base and of its inverse."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = (n // SHINGLE_BYTES + 1) * SHINGLE_BYTES
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, base, np.uint64)])) for base in (_ODD, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text.

    Words are runs of bytes other than the six ASCII white space characters, A-Z lower-cased.  Fewer words than
    `words`, but at least one, make the whole sequence one shingle.
    """
    raw = [t.encode("utf-8", "replace") for t in texts]
    flat = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    sizes = np.array([len(r) + 1 for r in raw])
    limits = np.cumsum(sizes)
    inside = ~_SPACES[flat]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    begin, end = edge[::2], edge[1::2]
    up, down = _powers(len(flat))
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[flat] * up[: len(flat)], out=total[1:])
    word = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    cuts = np.searchsorted(begin, limits)
    out, at = [], 0
    factors = mix(np.arange(1, words + 1, dtype=np.uint64) * _ODD) | _U(1)
    if len(word) >= words:
        rolled = np.zeros(len(word) - words + 1, np.uint64)
        for k in range(words):
            rolled += mix(word[k : len(word) - words + 1 + k] * factors[k])
        rolled = mix(rolled)
    else:
        rolled = np.zeros(0, np.uint64)
    for cut in cuts.tolist():
        n = cut - at
        if n >= words:
            out.append(np.unique(rolled[at : cut - words + 1]))
        elif n:
            short = _U(n)
            for k in range(n):
                short = (mix(np.array([short ^ word[at + k]], np.uint64)) + factors[k : k + 1])[0]
            out.append(np.array([short], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at = cut
    return out


def band_hashes(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """For each non-empty set, one hash per band of the minima and maxima of the band's permutations."""
    random = np.random.default_rng(SEED + 1)
    factors = random.integers(0, 1 << 63, (bands, PER_BAND), dtype=np.uint64) * _U(2) + _U(1)
    shifts = random.integers(0, 1 << 63, (bands, PER_BAND), dtype=np.uint64)
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        own = np.full(len(sets), mix(np.array([b], np.uint64))[0])
        for k in range(PER_BAND):
            moved = flat * factors[b, k]
            moved += shifts[b, k]
            own = mix(own ^ (np.minimum.reduceat(moved, starts) >> _U(20)))
            own = mix(own ^ (np.maximum.reduceat(moved, starts) >> _U(20)))
        out[:, b] = own
    return out


_SIGNATURE = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """Rows (doc_id, text) -> doc_id, n_shingles, digest of the set (null for an empty one) and its bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, texts in text_slices(rows.column("text"), SHINGLE_BYTES):
                sets = shingle_sets([x or "" for x in texts.to_pylist()], words)
                full = [s for s in sets if len(s)]
                hashes = iter(band_hashes(full, bands).view(np.int64)) if full else iter(())
                yield batch(
                    {
                        "doc_id": rows.column("doc_id").slice(a, b - a),
                        "n_shingles": [len(s) for s in sets],
                        "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
                        "bands": [next(hashes) if len(s) else [] for s in sets],
                    },
                    _SIGNATURE,
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """Rows (doc_id, text) -> doc_id and the sorted set as 64-bit numbers in a binary."""
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for a, b, texts in text_slices(rows.column("text"), SHINGLE_BYTES):
                sets = shingle_sets([x or "" for x in texts.to_pylist()], words)
                yield batch({"doc_id": rows.column("doc_id").slice(a, b - a), "shingles": [s.tobytes() for s in sets]}, schema)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles binary")


def overlaps(pairs: DataFrame) -> DataFrame:
    """Rows (a, b, of_a, of_b) with sets -> (a, b, common, whole): sizes of intersection and union."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64()), ("whole", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            common, whole = [], []
            for x, y in zip(rows.column("of_a"), rows.column("of_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate([x, y])
                both.sort()
                n = int((both[1:] == both[:-1]).sum())
                common.append(n)
                whole.append(len(both) - n)
            yield batch({"a": rows.column("a"), "b": rows.column("b"), "common": common, "whole": whole}, schema)

    return pairs.select("a", "b", "of_a", "of_b").mapInArrow(run, "a long, b long, common long, whole long")


def met(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) with the sets (doc_id, shingles) of both: a, b, of_a, of_b.  Any b may be in any share of the pairs."""
    weights = pairs.groupBy(F.col("b").alias("doc_id")).agg(F.count("*").alias("n"))
    with_a = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("of_a")), "a").withColumnRenamed("b", "doc_id")
    return unique_join(with_a, sets, "doc_id", weights).select("a", F.col("doc_id").alias("b"), "of_a", F.col("shingles").alias("of_b"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) and sets (doc_id, shingles) -> overlaps of every pair, with `linked`."""
    return overlaps(met(pairs, sets)).withColumn("linked", F.expr(f"100 * common >= {percent} * whole"))


def classes(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Documents (doc_id, text) -> doc_id, n_shingles, component_id, kept, one row per document.

    Documents are linked if 100 * |intersection| >= percent * |union| of their shingle sets; component_id is the
    smallest doc_id reachable over links.  Defined cases: a null, empty or white text has no shingles, is linked with
    nothing and is kept; equal sets are linked; rows that share a doc_id count as one document for links if their sets
    are equal, and otherwise join their classes; a null doc_id is linked with nothing; other columns are ignored; an
    empty table gives no rows.
    """
    with scratch(docs.sparkSession):
        return staged(_classes(docs, words, percent), "classes", keep=True)


def _classes(docs: DataFrame, words: int, percent: int) -> DataFrame:
    known = staged(signatures(docs, words, bands_for(percent)), "signatures")
    full = known.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    equal = full.groupBy("digest").agg(F.min("doc_id").alias("first"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    one = staged(equal, "sets")  # a row for each different set
    in_band = one.select(F.explode("bands").alias("band"), F.col("first").alias("doc"), "n")
    counts = staged(in_band.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    members = staged(unique_join(in_band.withColumnRenamed("n", "size"), counts.withColumn("many", F.col("n")).select("band", "many"), "band", counts), "members")
    degree = members.groupBy("doc").agg(F.sum("many").alias("degree"))
    centre = staged(members.join(degree, "doc").groupBy("band").agg(F.max_by(F.struct("doc", "size"), F.struct("degree", -F.col("doc"))).alias("pivot")), "pivots")
    paired = unique_join(members, centre, "band", counts)
    stars = staged(paired.select("doc", "size", F.col("pivot.doc").alias("pivot"), F.col("pivot.size").alias("pivot_size")).distinct(), "stars")
    near = F.expr(f"100 * least(size, pivot_size) >= {percent} * greatest(size, pivot_size)")
    pairs = stars.where("doc <> pivot").where(near).select(F.col("doc").alias("a"), F.col("pivot").alias("b"))
    wanted = staged(members.select(F.col("doc").alias("doc_id")).distinct(), "wanted")
    # texts stay where they are: sets are made of few documents but those in buckets, and only these sets move
    sets = staged(sets_of(sieved(docs.select("doc_id", "text"), wanted, "doc_id"), words).join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id", "shingles"]), "shingles")
    links = staged(confirm(pairs, sets, percent).where("linked"), "links").select(F.col("a").alias("u"), F.col("b").alias("v"))
    label = staged(components(links), "labels")
    more = staged(bucket_links(members.select("band", "doc"), centre.select("band", "pivot.doc"), stars.select("doc", "pivot"), label, sets, percent).distinct(), "links")
    if not more.isEmpty():
        tied = label.select(F.col("node").alias("u"), F.col("component").alias("v"))
        label = staged(components(tied.unionAll(more)), "labels")
    # rows of equal sets hang on their first; ids with several sets tie those together
    own = full.select("doc_id", "digest").join(one.select("digest", "first"), "digest").select("doc_id", "first").distinct()
    several = own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not several.isEmpty():
        tied = label.select(F.col("node").alias("u"), F.col("component").alias("v"))
        label = staged(components(tied.unionAll(own.select(F.col("doc_id").alias("u"), F.col("first").alias("v")))), "labels")
    named = one.select("digest", "first").join(label.withColumnRenamed("node", "first"), "first", "left").select("digest", F.coalesce("component", "first").alias("component"))
    sizes = full.groupBy("digest").agg(F.count("*").alias("n"))
    linked = unique_join(full.select("doc_id", "n_shingles", "digest"), named, "digest", sizes).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    alone = known.where(F.col("digest").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


_DELTA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("novel", pa.binary()), ("gone", pa.binary()), ("size_b", pa.int64())])


def deltas(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) -> what a's set has beyond b's, what it lacks of it, and the size of b's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out: dict[str, list] = {"novel": [], "gone": [], "size_b": []}
            for x, y in zip(rows.column("of_a"), rows.column("of_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                out["novel"].append(np.setdiff1d(x, y, assume_unique=True).tobytes())
                out["gone"].append(np.setdiff1d(y, x, assume_unique=True).tobytes())
                out["size_b"].append(len(y))
            yield batch({"a": rows.column("a"), "b": rows.column("b")} | out, _DELTA)

    return met(pairs, sets).mapInArrow(run, "a long, b long, novel binary, gone binary, size_b long")


def shared(left: list[np.ndarray], right: list[np.ndarray], n: int) -> np.ndarray:
    """How many numbers each of `left` has in common with each of `right`, as a matrix with n columns."""
    counts = np.zeros(len(left) * n, np.int64)
    if not right or not sum(map(len, right)):
        return counts.reshape(len(left), n)
    of_right = np.concatenate(right)
    owner = np.repeat(np.arange(n), [len(x) for x in right])
    order = np.argsort(of_right, kind="stable")
    of_right, owner = of_right[order], owner[order]
    for k, own in enumerate(left):
        a, b = np.searchsorted(of_right, own, "left"), np.searchsorted(of_right, own, "right")
        times = b - a
        at = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(a, times)
        counts[k * n : (k + 1) * n] = np.bincount(owner[at], minlength=n)
    return counts.reshape(len(left), n)


#: Members of a bucket that one task compares: outside the largest component, and of all.
MINOR_BLOCK, ALL_BLOCK = 64, 256
_LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def labelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """Rows with a column doc -> their component; a document without links is its own."""
    return rows.join(label.select(F.col("node").alias("doc"), "component"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def mixed(rows: DataFrame, key: str) -> DataFrame:
    """Keys whose rows (key, component) are of several components: key, many (its rows), most (those of the largest component), largest."""
    shares = rows.groupBy(key, "component").agg(F.count("*").alias("share"))
    each = shares.groupBy(key).agg(F.count("*").alias("kinds"), F.sum("share").alias("many"), F.max("share").alias("most"), F.max_by("component", F.struct("share", -F.col("component"))).alias("largest"))
    return each.where("kinds > 1").drop("kinds")


def bucket_links(members: DataFrame, centre: DataFrame, stars: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (u, v) between components that meet in a bucket; members: (band, doc), centre: (band, doc) the pivots, stars: (doc, pivot), distinct.

    Candidates are documents that share a bucket.  In every bucket, each member outside its largest component is
    compared with each member of another component.  Members come as their differences from the pivot's set, from
    which their overlap follows exactly: |x & y| = |p| - |gone x| - |gone y| + |gone x & gone y| + |novel x & novel y|.
    A bucket is dealt out in blocks, so that no task holds a whole one, and gives one link for each two components in a
    block.  Buckets whose pivot has one component around it are left out before they are looked at.
    """
    around = mixed(labelled(stars, label), "pivot").select("pivot")
    bands = centre.withColumnRenamed("doc", "pivot").join(around, "pivot", "left_semi")
    inside = labelled(unique_join(members, bands, "band", counted(members, "band")), label)
    inside = staged(inside, "inside")
    several = staged(mixed(inside, "band"), "mixed")
    inside = unique_join(inside, several, "band", several.select("band", F.col("many").alias("n")))
    changes = deltas(inside.select(F.col("doc").alias("a"), F.col("pivot").alias("b")).distinct(), sets).select(F.col("a").alias("doc"), F.col("b").alias("pivot"), "novel", "gone", "size_b")
    known = staged(inside.join(changes, ["doc", "pivot"]), "differences")
    h = F.xxhash64("doc")
    minors, alls = F.ceil((F.col("many") - F.col("most")) / MINOR_BLOCK).cast("int"), F.ceil(F.col("many") / ALL_BLOCK).cast("int")
    known = known.select("band", "doc", "component", "largest", "novel", "gone", "size_b", h.alias("h"), minors.alias("minors"), alls.alias("alls"))
    keep = ["band", "x", "y", "component", "novel", "gone", "size_b"]
    minor = known.where("component <> largest").withColumn("x", F.expr("pmod(h, minors)").cast("int")).withColumn("y", F.explode(F.expr("sequence(0, alls - 1)"))).select(*[F.col(c).alias(c) for c in keep])
    other = known.withColumn("y", F.expr("pmod(h, alls)").cast("int")).withColumn("x", F.explode(F.expr("sequence(0, minors - 1)"))).select(*[F.col(c).alias(c) for c in keep])

    def arrays(rows: pa.Table, name: str) -> list[np.ndarray]:
        return [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column(name)]

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return _LINK.empty_table()
        p = left.column("size_b")[0].as_py()
        (novel_x, gone_x), (novel_y, gone_y) = ([arrays(t, c) for c in ("novel", "gone")] for t in (left, right))
        lacks_x, lacks_y, more_x, more_y = (np.array([len(v) for v in w]) for w in (gone_x, gone_y, novel_x, novel_y))
        n = len(right)
        common = p - lacks_x[:, None] - lacks_y[None, :] + shared(gone_x, gone_y, n) + shared(novel_x, novel_y, n)
        whole = (p - lacks_x + more_x)[:, None] + (p - lacks_y + more_y)[None, :] - common
        of_x, of_y = left.column("component").to_numpy(), right.column("component").to_numpy()
        a, b = np.nonzero((100 * common >= percent * whole) & (of_x[:, None] != of_y[None, :]))
        found = np.unique(np.stack([of_x[a], of_y[b]], 1), axis=0) if len(a) else np.zeros((0, 2), np.int64)
        return pa.table({"u": found[:, 0], "v": found[:, 1]}, schema=_LINK)

    one = ["band", "x", "y"]
    return minor.groupBy(*one).cogroup(other.groupBy(*one)).applyInArrow(compare, "u long, v long")
