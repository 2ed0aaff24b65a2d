"""Near-duplicates, top-k, quality, shards, repeated passages, the graph helpers and the pipeline."""

import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from keyloom.llm import common, graph, near_dedup, packing, pii, pipeline, quality, queries, shards, suffix_dedup, suffix_order, topk

from .conftest import DATA

# -- near-duplicates


def plain_sets(texts, words):
    out = []
    for t in texts:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\v\f\r":
            w = w.replace(c, " ")
        w = [x for x in w.split(" ") if x]
        out.append({tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set())
    return out


def plain_classes(pairs, words, percent):
    sets = plain_sets([t for _, t in pairs], words)
    parent = list(range(len(pairs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(pairs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                if pairs[a][0] < pairs[b][0]:
                    a, b = b, a
                parent[a] = b
    return {(pairs[i][0], len(sets[i]), pairs[root(i)][0]) for i in range(len(pairs))}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉ \n\x1c\xa0", max_size=30), min_size=1, max_size=6), st.sampled_from([3, 5]))
def test_shingle_sets_have_the_sizes_and_overlaps_of_the_real_ones(texts, words):
    own, real = near_dedup.shingle_sets(texts, words), plain_sets(texts, words)
    assert [len(s) for s in own] == [len(s) for s in real]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(own[i], own[j])) == len(real[i] & real[j])


def test_bands_find_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    sets = [np.unique(np.concatenate([base[:368], rng.integers(0, 1 << 63, 32, dtype=np.uint64)])) for _ in range(40)]
    bands = near_dedup.band_hashes([np.unique(base), *sets], near_dedup.bands_for(85))
    assert all((b == bands[0]).any() for b in bands[1:])


def edited(words, rng, n):
    words = list(words)
    for k in rng.choice(len(words), n, replace=False):
        words[k] = f"z{rng.integers(1e9)}"
    return " ".join(words)


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_classes_equal_brute_force(docs, words, percent):
    rng = np.random.default_rng(words)
    pairs = []
    for group in range(6):
        base = [f"w{rng.integers(1e6)}" for _ in range(150)]
        for _ in range(25):
            pairs.append((len(pairs), edited(base, rng, int(rng.integers(0, 9)))))
        pairs += [(len(pairs), " ".join(base)), (len(pairs) + 1, " ".join(base).upper())]
    pairs += [(len(pairs) + k, t) for k, t in enumerate([None, "", " \n", "one", "ONE", "one two", "one two three"])]
    found = near_dedup.classes(docs(pairs), words, percent).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found} == plain_classes(pairs, words, percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_classes_of_odd_rows(nasty):
    rows = near_dedup.classes(nasty, 3, 85).collect()
    assert len(rows) == nasty.count() and near_dedup.classes(nasty.limit(0), 3, 85).count() == 0
    by = {r["doc_id"]: r for r in rows}
    assert by[9]["component_id"] == 8 and not by[9]["kept"] and by[0]["n_shingles"] == 0 and by[0]["kept"] and all(r["kept"] for r in rows if r["doc_id"] is None)


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(9, k) for k in range(1, 9)] + [(50, 50), (200, 9), (9, 200)]
    found = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(found[i] == 100 for i in range(100, 141)) and all(found[k] == 1 for k in [*range(1, 10), 200]) and 50 not in found
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_of_one_class_of_many(spark):
    """A star and a chain of stars of 10^5 nodes: the hot root is dealt out in every join."""
    n = 100_000
    star = spark.range(1, n).select(F.lit(0).cast("long").alias("u"), F.col("id").alias("v"))
    hubs = spark.range(1, n).select((n + F.col("id") % 7).alias("u"), (2 * n + F.col("id")).alias("v"))
    chain = spark.createDataFrame([(n + k, n + k + 1) for k in range(6)], "u long, v long")
    found = graph.components(star.unionAll(hubs).unionAll(chain)).groupBy("component").agg(F.count("*").alias("n")).collect()
    assert {r["component"]: r["n"] for r in found} == {0: n, n: n - 1 + 7}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_unique_join_of_hot_keys(spark, how):
    left = spark.createDataFrame([(k, i, 0) for i in range(4000) for k in ([1] if i % 2 else [i])] + [(None, -1, 0)], "key long, x long, salt int")
    right = spark.createDataFrame([(k, k * 10, 1) for k in range(0, 1000)], "key long, y long, parts int")
    weights = graph.counted(left, "key")
    joined = graph.unique_join(left, right, "key", weights, how=how)
    found = sorted(map(tuple, joined.collect()), key=repr)
    assert found == sorted(map(tuple, left.join(right, "key", how).select("key", "x", "salt", "y", "parts").collect()), key=repr)
    spread = graph.unique_join(left, right, "key", weights).where("key = 1").repartition(1)  # the plan deals the hot key out
    assert "hot_key" in spread._jdf.queryExecution().toString()


@pytest.mark.parametrize("most", [1 << 15, 1 << 26])
def test_sieve_loses_no_row_of_a_key(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "SIEVE_MOST", most)
    left = spark.range(-3000, 3000).select(F.col("id").alias("key"), F.col("id").alias("place"), F.lit("x").alias("bucket"))
    left = left.unionAll(left.where("key < 5")).unionAll(spark.sql("select cast(null as long), 0L, 'x'"))
    keys = spark.range(-3000, 3000, 7).select(F.col("id").alias("key")).unionAll(spark.sql("select cast(null as long)"))
    kept = graph.sieved(left, keys, "key")
    assert kept.columns == left.columns
    assert sorted(kept.join(keys, "key", "left_semi").collect()) == sorted(left.join(keys, "key", "left_semi").collect())
    assert kept.where("key is null").isEmpty() and kept.count() < left.count() / 2
    assert graph.sieved(left, keys.limit(0), "key").isEmpty() and graph.sieved(left.limit(0), keys, "key").isEmpty()


def test_classes_of_a_large_group(docs):
    """Near copies of one text, more than any block holds, and texts that share a band with them by a long passage."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(60)]
    pairs = [(k, edited(base, rng, 1)) for k in range(6000)]
    other = [f"v{k}" for k in range(60)]
    pairs += [(10_000 + k, edited(other, rng, 1)) for k in range(50)]
    found = near_dedup.classes(docs(pairs), 3, 85).groupBy("component_id").count().collect()
    assert {r["component_id"]: r["count"] for r in found} == {0: 6000, 10_000: 50}


def test_buckets_link_what_their_pivots_do_not(docs, monkeypatch):
    """Chains whose ends are far apart: members of a bucket link one another where neither links the pivot."""
    monkeypatch.setattr(near_dedup, "MINOR_BLOCK", 2)
    monkeypatch.setattr(near_dedup, "ALL_BLOCK", 3)
    rng = np.random.default_rng(12)
    pairs = []
    for g in range(12):
        words = [f"g{g}w{k}" for k in range(120)]
        for step in range(14):
            for k in range(2):
                words[(7 * step + 3 * k + g) % 120] = f"z{rng.integers(1e9)}"
            pairs.append((len(pairs), " ".join(words)))
    found = near_dedup.classes(docs(pairs), 3, 85).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found} == plain_classes(pairs, 3, 85)


# -- top-k


def plain_top(rows, k):
    out = set()
    vectors = [(i, [int(np.floor(64 * float(c))) for c in v]) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    for q, x in vectors:
        if q % 20 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in vectors if i != q and len(x) == len(y)))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def cut(rows):
    return {(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in rows}


@pytest.mark.parametrize("seed", range(2))
def test_top_k_equals_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 4 * 6 * 8)
    monkeypatch.setattr(topk, "ROW_BYTES", 32 * 6 * 8)
    rng = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(c)) for c in rng.normal(0, 1 + seed, 6).round(seed)]) for i in range(150)]
    rows += [(200, None), (220, [1.0, None]), (240, [float("nan")] * 6), (260, [float("inf")] * 6), (280, []), (281, []), (300, [1.0, 2.0]), (301, [3.0, 4.0]), (None, [1.0] * 6)]
    rows += [(320, [3e30] * 6), (321, [-2e30] * 6), (340, [1e30] * 5 + [-3e30]), (361, [2.0**40] * 6), (380, [0.0] * 6)]
    frame = spark.createDataFrame([(i, v, 1, "q") for i, v in rows], "vec_id long, embedding array<float>, dim int, score string")
    found = {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, 20).collect()}
    real = [(i, None if v is None else [c if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    assert found == cut(plain_top(real, 20))
    assert topk.top_k(frame.limit(0), F.lit(True)).count() == 0


def test_scores_beyond_64_bits_are_ranked(spark):
    """Scores that all show as the same 64-bit number, up and down, and components whose scaled value is no double any more."""
    rows = [(0, [1e300, 1.0]), (20, [-1e300, 2.0])] + [(i, [float(i) * 1e12, 0.0]) for i in range(1, 8)] + [(11, [1e307, 0.0]), (12, [-1.5e308, 0.0]), (13, [0.0, 5.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    scores = lambda q: sorted((-sum(int(a) * 64 * int(b) * 64 for a, b in zip(q[1], v, strict=True)), i) for i, v in rows if i != q[0])
    expected = cut({(q[0], r + 1, i, -s) for q in rows[:2] for r, (s, i) in enumerate(scores(q)[:5])})
    assert {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, 5).collect()} == expected
    assert sorted([2**200, 2**63, 2**63 - 1, -(2**63) - 1, -(2**300), 2**64], key=lambda s: (topk.over(s), min(s, 2**63 - 1))) == [-(2**300), -(2**63) - 1, 2**63 - 1, 2**63, 2**64, 2**200]


def test_queries_of_one_id_give_their_own_ranks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BYTES", 2 * 4 * 8)
    monkeypatch.setattr(topk, "ROW_BYTES", 16 * 4 * 8)
    rng = np.random.default_rng(4)
    a, b = rng.integers(-9, 9, (2, 4)).astype(float).tolist()
    others = [(i, rng.integers(-9, 9, 4).astype(float).tolist()) for i in range(1, 60)]
    frame = spark.createDataFrame([(0, a), (0, a), (0, b), *others], "vec_id long, embedding array<float>")
    expected = [x for v in (a, a, b) for x in plain_top([(0, v), *((i, w) for i, w in others if i % 20)], 20)]
    found = topk.top_k(frame.where("vec_id = 0 or vec_id % 20 <> 0"), F.col("vec_id") == 0, 20).collect()
    assert sorted(map(tuple, found)) == sorted(expected)


def side(x, ids, pivots):
    q, _ = topk.quantised(x.ravel(), x.shape[1])
    return topk.Side(x, ids, topk.to_pivots(q, pivots), (q * q).sum(1))


def test_search_stops_before_all_candidates():
    rng = np.random.default_rng(3)
    centres = rng.integers(-400, 400, (20, 16))
    rows = (centres[rng.integers(0, 20, 4000)] + rng.integers(-3, 3, (4000, 16))).astype(float)
    pivots = topk.choose_pivots(topk.quantised(rows[:500].ravel(), 16)[0])
    evaluated = []
    query, ids, scores = topk.search(side(rows[:5], np.arange(5), pivots), side(rows, np.arange(4000), pivots), 20, np.full(5, -np.inf), evaluated)
    assert sum(evaluated) < 0.6 * 5 * 4000
    for at in range(5):
        real = (rows * 64) @ (rows[at] * 64)
        real[at] = -np.inf
        assert sorted(scores[query == at], reverse=True) == sorted(real, reverse=True)[:20] and at not in ids[query == at]


def test_blocks_are_skipped(spark, monkeypatch):
    """Clustered vectors: the pivots' ranges leave a query few of the blocks, and the results are those of brute force."""
    monkeypatch.setattr(topk, "ROW_BYTES", 64 * 8 * 8)
    rng = np.random.default_rng(9)
    centres = rng.normal(0, 8, (12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.05, 8)).astype(np.float32).astype(float).tolist()) for i in range(1200)]
    seen, real = [], topk.visits

    def watched(queries, blocks, first):
        out = real(queries, blocks, first)
        seen.append((out.count(), queries.count() * sum(blocks.count.values())))
        return out

    monkeypatch.setattr(topk, "visits", watched)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, 20).collect()} == plain_top(rows, 20)
    assert sum(n for n, _ in seen) < 0.3 * seen[0][1]
    monkeypatch.setattr(topk, "MOST_RANGES", 1)  # without ranges every block is visited, with the same results
    assert {tuple(r) for r in topk.top_k(frame, F.col("vec_id") % 20 == 0, 20).collect()} == plain_top(rows, 20)


# -- quality


def test_quality_learns_and_holds_out(spark, docs):
    rng = np.random.default_rng(0)
    good = [" ".join(f"{''.join(rng.choice(list('etaoin'), 5))}" for _ in range(80)) + "." for _ in range(150)]
    bad = ["!! ".join(["SPAM"] * 80) + f" {i}" for i in range(150)]
    pairs = [*enumerate(good), *((1000 + i, t) for i, t in enumerate(bad)), (5000, None), (5001, ""), (None, good[0])]
    labels = spark.createDataFrame([(i, int(i < 1000)) for i, _ in pairs[:300]] + [(5000, None), (77777, 1)], "doc_id long, quality int")
    rows = quality.classify(docs(pairs), labels).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        held = r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1
        assert r["held_out"] == held and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
    judged = [r for r in rows if r["doc_id"] is not None and r["doc_id"] < 2000 and r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] < 1000) for r in judged) >= 0.95 * len(judged)
    kept = quality.accepted(docs(pairs), labels)
    assert kept.columns == docs([]).columns and sum(r["doc_id"] is not None and r["doc_id"] >= 1000 for r in kept.where("doc_id < 2000").collect()) <= 7


def test_quality_without_labels(docs, spark, nasty):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(nasty, empty).collect()} == {0.5}
    assert quality.classify(nasty.limit(0), empty).count() == 0
    ones = spark.createDataFrame([(4, 1), (5, 1), (6, 1), (7, 1)], "doc_id long, quality int")
    assert {r["score"] for r in quality.classify(nasty, ones).collect()} == {1.0}


def test_isotonic_is_monotone():
    at, y = np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0])
    x, v = quality.isotonic(at, y, np.ones(6))
    assert (np.diff(v) >= 0).all() and (np.diff(x) > 0).all()


def plain_quality(pairs, labels):
    """The whole score in NumPy: ridge by least squares on all rows, isotonic means by the minimax formula."""
    crc = np.array([zlib.crc32(str(i).encode()) for i, _ in pairs])
    x = np.array([quality.statistics(t or "") for _, t in pairs], np.float32).astype(float)
    at = np.array([i for i, (d, _) in enumerate(pairs) if labels.get(d) is not None and crc[i] % 3 != 1])
    y, fold, d = np.array([float(labels[pairs[i][0]] > 0) for i in at]), crc[at] // 3 % 4, x.shape[1]
    mean = x[at].mean(0)
    scale = np.sqrt(np.maximum((x[at] ** 2).mean(0) - mean**2, 1e-8))
    random, m = np.random.default_rng(quality.SEED), quality.FEATURES
    directions, phases = random.normal(0, 1 / np.sqrt(2 * d), (d, m)), random.uniform(0, 2 * np.pi, m)
    z = np.column_stack([np.sqrt(2 / m) * np.cos(np.clip((x - mean) / scale, -6, 6) @ directions + phases), np.ones(len(x))])

    def ridge(rows, p):
        pull = np.diag(np.sqrt([p * len(rows) + 1e-9] * m + [1e-9]))
        return np.linalg.lstsq(np.vstack([z[at][rows], pull]), np.concatenate([y[rows], np.zeros(m + 1)]), rcond=None)[0]

    others = [np.flatnonzero(fold != k) for k in range(4)]
    errors = {p: sum(((y - z[at] @ ridge(others[k], p))[fold == k] ** 2).sum() for k in range(4)) for p in quality.PENALTIES}
    p = min(errors, key=errors.get)
    raw = np.zeros(len(at))
    for k in range(4):
        raw[fold == k] = np.clip(z[at][fold == k] @ ridge(others[k], p), -0.5, 1.5)
    bins = np.minimum(((raw + 0.5) / 2 * quality.BINS).astype(int), quality.BINS - 1)
    used = np.unique(bins)
    n, ones, centre = (np.array([f(bins == b) for b in used]) for f in (np.sum, lambda w: y[w].sum(), lambda w: raw[w].mean()))
    level = [max(min(ones[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(n))) for a in range(i + 1)) for i in range(len(n))]
    block = np.cumsum(np.append(0, np.diff(level) > 1e-12))
    weight, good = np.bincount(block, n), np.bincount(block, ones)
    return np.interp(z @ ridge(np.arange(len(at)), p), np.bincount(block, n * centre) / weight, np.maximum.accumulate((good + y.mean()) / (weight + 1)))


def test_quality_equals_numpy(spark):
    data = DATA.replace("0.001", "0.01")
    docs, labels = (spark.read.parquet(f"{data}/{n}.parquet") for n in ("documents", "labels"))
    found = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    pairs = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    expected = plain_quality(pairs, {r["doc_id"]: r["quality"] for r in labels.collect()})
    assert np.abs(np.array([found[i] for i, _ in pairs]) - expected).max() < 1e-3


def test_quality_query_held_out_accuracy(spark):
    data = DATA.replace("0.001", "0.01")
    rows = queries.op6_quality_classifier(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.95 * len(rows)


# -- shards


def listed(df, *names):
    return sorted(map(repr, df.select(*names).collect() if names else df.collect()))


def test_shards(spark, docs, nasty, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=4000, fanout=3)
    assert store.version() == 0 and store.runs() == []
    with pytest.raises(ValueError):
        store.read()
    rows = nasty.withColumn("part", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)))
    assert store.append(rows, "part") == 1 and len(store.runs()) == 4
    store.append(rows.where("part = 1"), "part")
    old = store.read(1)
    last = store.compact()
    tiers = [t for t in map(store.tier, store.runs()) if t is not None]
    assert last == store.version() > 2 and all(tiers.count(t) < 3 for t in tiers)
    expected = sorted(listed(rows) + listed(rows.where("part = 1")))
    assert listed(store.read()) == expected
    assert old.count() == nasty.count()  # versions before stay readable until they are vacuumed
    store.vacuum()
    assert len(store.versions()) == last and old.count() == nasty.count()  # all is young
    store.vacuum(older_than_s=0)
    assert listed(store.read()) == expected and store.versions() == [last]
    live = {f.rpartition("/")[2] for r in store.runs() for f in r.files}
    assert {p.name for p in (tmp_path / "s/data").rglob("*.parquet")} == live
    with pytest.raises(shards.Conflict):
        store._commit(store.manifest())
    assert store.append(rows.limit(0), "part") == store.version()
    assert not list((tmp_path / "s/manifests").glob(".[0-9a-f]*[0-9a-f]"))
    with pytest.raises(ValueError):
        shards.ShardStore(spark, "x", fanout=1)


def test_later_columns_survive_read_and_compaction(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", fanout=2)  # two runs of a size are a full tier
    one, two = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(2, "b", 0.5, 7)], "doc_id long, text string, extra double, _arrival int")
    for k, rows in enumerate((one, two, one, two)):
        store.append(rows, F.lit(k))
    expected = sorted([(1, "a", None, None), (2, "b", 0.5, 7)] * 2)
    assert sorted(map(tuple, store.read().collect())) == expected and store.read(1).columns == ["doc_id", "text"]
    last = store.compact()
    assert last > 4 and len(store.runs()) < 4
    assert sorted(map(tuple, store.read().collect())) == expected
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([("x",)], "doc_id string"), F.lit(2))
    assert store.version() == last
    store.append(one.select("doc_id"), F.lit(2))
    assert sorted(map(tuple, store.read().collect()), key=repr) == sorted([*expected, (1, None, None, None)], key=repr)


def test_two_writers_and_a_vacuum_before_a_commit(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/s"
    first, second = shards.ShardStore(spark, path, fanout=2), shards.ShardStore(spark, path, fanout=2)
    rows = lambda k: spark.createDataFrame([(k, f"t{k}")], "doc_id long, text string")
    first.append(rows(0), F.lit(0))
    commit, late = shards.ShardStore._commit, []

    def slow(self, new):
        if self is first and not late:  # the other writer commits, and vacuums, between the write and the commit
            late.append(second.append(rows(2), F.lit(2)))
            second.vacuum()
        return commit(self, new)

    monkeypatch.setattr(shards.ShardStore, "_commit", slow)
    assert first.append(rows(1), F.lit(1)) == 3 and late == [2]
    assert sorted(r["doc_id"] for r in first.read().collect()) == [0, 1, 2]
    late.clear()
    merge = shards.ShardStore._merge

    def overtaken(self, runs, schema):
        if self is first and not late:
            late.append(second.compact())
        return merge(self, runs, schema)

    monkeypatch.setattr(shards.ShardStore, "_merge", overtaken)
    first.compact()
    assert sorted(r["doc_id"] for r in second.read().collect()) == [0, 1, 2]


def test_tiers_go_all_the_way_down_and_stop_at_the_target(spark, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/s", target_bytes=1000, fanout=4)
    run = lambda *sizes: shards.Run(tuple(f"data/f/{i}.parquet" for i in range(len(sizes))), sizes, (0,))
    assert [store.tier(run(n)) for n in (1, 3, 4, 15, 16, 63, 64, 499)] == [0, 0, 1, 1, 2, 2, 3, 4]
    assert store.tier(run(500)) is None and store.tier(run(900, 2000)) is None and store.tier(run(900, 17)) == 2


def test_sharding_an_empty_table(spark, tmp_path):
    (tmp_path / "sf").mkdir()
    spark.read.parquet(f"{DATA}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/sf/documents.parquet")
    assert queries.op7_sharding(spark, f"file://{tmp_path}/sf").collect() == []


# -- repeated passages


@settings(max_examples=100, deadline=None)
@given(st.binary(min_size=1, max_size=300).map(lambda b: bytes(97 + x % 2 for x in b)), st.sampled_from([(40, 16), (50, 32), (33, 33)]), st.integers(1, 4))
def test_minimisers_are_the_leftmost_of_the_least(text, sizes, parts):
    length, gram = sizes
    ends = np.unique(np.linspace(0, len(text), parts + 1).astype(int)[1:])
    flat = np.frombuffer(text, np.uint8)
    first, last, place, hashes = suffix_dedup.minimisers(flat, ends, length, gram)
    every = suffix_dedup.gram_hashes(flat, gram) if len(flat) >= gram else []
    found = {w: (p, h) for f, z, p, h in zip(first.tolist(), last.tolist(), place.tolist(), hashes.tolist(), strict=True) for w in range(f, z + 1)}
    starts = [0, *ends[:-1].tolist()]
    windows = [w for a, b in zip(starts, ends.tolist(), strict=True) for w in range(a, b - length + 1)]
    assert found == {w: (p, int(every[p])) for w in windows for p in [min(range(w, w + length - gram + 1), key=lambda p: (int(every[p]) >> 20, p))]}
    with pytest.MonkeyPatch.context() as patch:  # in parts, as a text of over a million bytes is
        patch.setattr(suffix_dedup, "_PLACE_BITS", 8)
        patch.setattr(suffix_dedup, "_PLACES", np.uint64(255))
        if len(flat) >= length:
            coarse = [min(range(w, w + length - gram + 1), key=lambda p: (int(every[p]) >> 8, p)) for w in range(len(flat) - length + 1)]
            assert suffix_dedup.leftmost_least(every, length - gram + 1).tolist() == coarse
    assert suffix_dedup.unpacked(suffix_dedup.packed(first, last, place, np.zeros_like(first)))[0].tolist() == first.tolist()


@pytest.mark.parametrize("length", [100, 47])
def test_window_keys_tell_windows_apart(length):
    """Keys of anchored windows are equal where the windows are, with names from the sorted triples, and sort like them within a class."""
    rng = np.random.default_rng(length)
    core = bytes(rng.integers(97, 99, 3 * length, dtype=np.uint8))
    bodies, n, g = [], [], []
    for _ in range(40):
        a, size = int(rng.integers(0, 60)), int(rng.integers(1, 30))
        own = bytearray(core[a : a + size + length - 1])
        for at in rng.integers(0, len(own), int(rng.integers(0, 3))):
            own[at] = 120
        bodies.append(bytes(own))
        n.append(size)
        g.append(90 - a)
    w = suffix_order.Windows(b"".join(bodies), np.array(n), np.array(g), length)
    triples, inverse = w.triples()
    rank = np.unique(suffix_order.as_strings(triples), return_inverse=True)[1]
    keys = suffix_order.as_strings(w.keys(rank[inverse]))
    real = [bodies[o][x : x + length] for o, x in zip(w.owner.tolist(), w.offset.tolist(), strict=True)]
    named = [(int(c), t) for c, t in zip(w.kind, real, strict=True)]
    assert len(set(named)) == len(np.unique(keys)) and len(set(w.kind.tolist())) == 3
    order = np.argsort(keys, kind="stable")
    assert [named[i] for i in order] == sorted(named)


def test_triples_with_equal_hashes_are_told_apart(monkeypatch):
    words = [np.array([5, 6, 5, 7, 5], np.uint64), np.array([1, 2, 1, 3, 9], np.uint64)]
    for factors in (suffix_order._FACTORS, np.zeros(2, np.uint64)):
        monkeypatch.setattr(suffix_order, "_FACTORS", factors)
        first, inverse = suffix_order.different(words)
        assert len(first) == 4 and all((w[first][inverse] == w).all() for w in words)


def plain_dedup(pairs, length):
    seen, out = set(), []
    for doc, text in pairs:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - length + 1):
            if raw[j : j + length] in seen:
                gone[j : j + length] = b"\1" * length
            seen.add(raw[j : j + length])
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.fixture(params=["as used", "small"])
def sizes(request, monkeypatch):
    """Blocks, ranges and batches as they are, and so small that there are many."""
    if request.param == "small":
        monkeypatch.setattr(suffix_order, "BLOCK_BYTES", 700)
        monkeypatch.setattr(suffix_order, "RANGE_BYTES", 1500)
        monkeypatch.setattr(suffix_dedup, "CUT_BYTES", 1000)
        monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", 900)
    return request.param


def test_repeats_equal_brute_force(docs, sizes):
    rng = np.random.default_rng(len(sizes))
    letters = np.array(list("abcdefg é"))
    passages = ["".join(rng.choice(letters, n)) for n in (99, 100, 101, 150, 400)]
    pairs = []
    for i in range(60):
        body = "".join("".join(rng.choice(letters, rng.integers(0, 90))) + passages[rng.integers(5)] for _ in range(rng.integers(0, 5)))
        pairs.append((i, body))
    pairs += [(60, pairs[3][1]), (61, pairs[4][1] + "x"), (62, "ab" * 300), (63, "a" * 700), (64, "ba" * 300), (65, None), (66, ""), (67, passages[4] * 3), (68, passages[4][:99])]
    found = sorted(map(tuple, suffix_dedup.dedup(docs(pairs)).collect()))
    assert found == plain_dedup(pairs, 100)


def test_repeats_of_odd_rows(docs, nasty):
    rows = suffix_dedup.dedup(nasty).collect()
    assert len(rows) == nasty.count() and suffix_dedup.dedup(nasty.limit(0)).count() == 0
    twice = docs([(1, "q" * 50 + "w" * 60), (1, "q" * 50 + "w" * 60), (None, "q" * 50 + "w" * 60), (0, "q" * 50 + "w" * 60)])
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in suffix_dedup.dedup(twice).collect()) == [(False, 110), (False, 110), (False, 110), (True, 0)]
    kept = suffix_dedup.remove(twice)
    assert kept.columns == twice.columns and sorted(r["text"] for r in kept.collect())[:3] == [""] * 3


def test_clashing_columns_stay(spark):
    text = "".join(np.random.default_rng(2).choice(list("abcdefg"), 150))
    rows = spark.createDataFrame([(1, text, 1, 2, 3, 4, 5, 6, 7), (2, text, 1, 2, 3, 4, 5, 6, 7), (2, text, 1, 2, 3, 4, 5, 6, 8)], "doc_id long, text string, _k int, _d int, _spans int, _n int, _nth int, _salt int, first int")
    found = suffix_dedup.remove(rows)
    assert found.columns == rows.columns and sorted((r["doc_id"], len(r["text"])) for r in found.collect()) == [(1, 150), (2, 0), (2, 0)]
    kept = pipeline.minhash_near_dedup(spark, rows, DATA)
    assert kept.columns == rows.columns and [r["doc_id"] for r in kept.collect()] == [1]


def test_a_passage_in_very_many_documents(spark, sizes):
    """One passage in 1,500 documents, each time between other words: it stays in the first, and no window of it is lost."""
    rng = np.random.default_rng(7)
    passage = "".join(rng.choice(list("abcdefg "), 260))
    pairs = [(i, f"{rng.integers(1e12)} {passage} {rng.integers(1e12)}") for i in range(1500 if sizes == "as used" else 150)]
    frame = spark.createDataFrame(pairs, "doc_id long, text string")
    assert sorted(map(tuple, suffix_dedup.dedup(frame).collect())) == plain_dedup(pairs, 100)


def test_repeated_rows_keep_one_copy_of_their_passages(docs, sizes):
    rng = np.random.default_rng(5)
    shared, within, a, b, c = ("".join(rng.choice(list("abcdefg é"), n)) for n in (180, 150, 90, 70, 60))
    mine, other = a + shared + within + b + within, c + shared + b
    found = sorted(map(tuple, suffix_dedup.dedup(docs([(5, mine), (9, other), (5, mine), (5, mine)])).collect()))
    n = len(mine.encode())
    whole = (5, n, n, 1, hashlib.sha256(b"").hexdigest())
    assert found == sorted([*plain_dedup([(5, mine), (9, other)], 100), whole, whole])
    texts = [r["text"] for r in suffix_dedup.remove(docs([(5, mine), (9, other), (5, mine)])).collect()]
    assert sum(t.count(shared) for t in texts) == 1 and sum(t.count(within) for t in texts) == 1


def test_passage_of_two_texts_whose_keys_share_a_short_hash(spark, docs):
    passage = "".join(np.random.default_rng(6).choice(list("abcdefg"), 150))
    text = F.concat(F.col("id").cast("string"), F.lit(" " + passage))
    short = spark.range(300_000).groupBy(F.hash(F.xxhash64(text)).alias("h")).agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").orderBy("h").first()
    pairs = [(i, f"{i} {passage}") for i in sorted((short["a"], short["b"]))]
    assert sorted(map(tuple, suffix_dedup.dedup(docs(pairs)).collect())) == plain_dedup(pairs, 100)


def test_repeats_query(spark):
    pairs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    assert sorted(map(tuple, queries.op8_suffix_array_dedup(spark, DATA).collect())) == plain_dedup(pairs, 100)


# -- pipeline


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), DATA).columns == docs.columns, name
    deduped = pipeline.minhash_near_dedup(spark, docs, DATA)
    pairs = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    assert {r["doc_id"] for r in deduped.collect()} == {c for _, _, c in plain_classes(pairs, 5, 80)}


def test_near_dedup_decides_by_text_where_ids_repeat(spark, docs):
    rng = np.random.default_rng(8)
    a, b, c, d = (" ".join(rng.choice(["red", "blue", "green", "grey", "pink"], 60)) for _ in range(4))
    near = a + " more"
    pairs = [(1, a), (2, near), (2, b), (2, b), (3, c), (3, c + " more"), (4, d), (5, None), (5, ""), (6, b), (None, a), (None, a)]
    found = pipeline.minhash_near_dedup(spark, docs(pairs), DATA)
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
    expected = [(1, a), (2, b), (3, c), (4, d), (5, None), (5, ""), (None, a), (None, a)]
    assert found.columns == docs(pairs).columns and sorted(((r["doc_id"], r["text"]) for r in found.collect()), key=key) == sorted(expected, key=key)


def test_pipeline_runs(spark):
    """The pipeline's pieces are those of its stages in plain Python, after the documents that the classifier accepts."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == packing.PACKED.names and out.count() > 0
    good = quality.accepted(docs, spark.read.parquet(f"{DATA}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    kept = sorted({c for _, _, c in plain_classes(sorted(texts.items()), 5, 80)})
    seen, left = set(), []
    for i in kept:
        raw = (texts[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for j in range(len(raw) - 99):
            gone[j : j + 100] |= raw[j : j + 100] in seen
            seen.add(raw[j : j + 100])
        left.append((i, bytes(np.frombuffer(raw, np.uint8)[~gone]).decode("utf-8", "ignore")))
    counts = {}
    for _, text in left:
        for kind, _, _, votes, found in pii.propose(text)[1]:
            for trait in ("", *found):
                own = counts.setdefault(kind, {})
                own[votes, trait] = own.get((votes, trait), 0) + 1
    model = {kind: pii.classifier(own) for kind, own in counts.items()}
    tokenizer, expected = Tokenizer.from_file(queries.tokenizer_path()), []
    for i, text in left:
        ids = [*tokenizer.encode(pii.mask_text(text, model), add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for piece, a in enumerate([0, *range(first, len(ids), 2048)]):
            own = ids[a : first if a == 0 else a + 2048]
            expected.append((i, piece, a, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out.collect()) == sorted(expected)


# -- memory of workers


class Kernel:
    """Stands in for a DataFrame, to get at the function that an operator gives to mapInArrow."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


def test_text_slices_are_whole_and_small():
    texts = [None, "", "é" * 30, None, "a" * 50, "b" * 300, "c", "", None]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array(["cut off", *texts], kind).slice(1)
        for limit in (1, 50, 100, 1000):
            found = list(common.text_slices(column, limit))
            assert [x for _, _, part in found for x in part.to_pylist()] == texts
            assert [a for a, _, _ in found] == [0, *(b for _, b, _ in found[:-1])] and found[-1][1] == len(texts)
            sizes = [[len((x or "").encode()) for x in part.to_pylist()] for _, _, part in found]
            assert all(sum(own) <= limit or len([n for n in own if n]) == 1 for own in sizes)
        assert common.utf8(column.drop_null()) == [x.encode() for x in texts if x is not None]
    assert list(common.text_slices(pa.array([], pa.string()), 5)) == []


@pytest.mark.parametrize("kernel", [lambda: near_dedup.signatures(Kernel(), 5, 2), lambda: near_dedup.sets_of(Kernel(), 5), lambda: suffix_dedup.index(Kernel(), 100), lambda: suffix_dedup.strings(Kernel(), 100)])
def test_workers_do_not_hold_a_batch_of_texts_twice(kernel, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHINGLE_BYTES", 1 << 16)
    monkeypatch.setattr(suffix_dedup, "INDEX_BYTES", 1 << 16)
    monkeypatch.setattr(suffix_dedup, "CUT_BYTES", 1 << 16)
    n, size = 400, 1 << 16
    texts = pa.array(["words of a text and some more of them " * (size // 39)] * n)
    ids = pa.array(range(n), pa.int64())
    found = pa.array([[]] * n, pa.list_(pa.struct([("run", pa.int64()), ("hash", pa.int64())])))
    rows = pa.RecordBatch.from_arrays([ids, ids, ids, texts, found], names=["doc_id", "d", "k", "text", "found"])
    run = kernel()
    list(run(iter([rows.slice(0, 1)])))  # tables that are made once
    tracemalloc.start()
    try:
        for _ in run(iter([rows])):
            pass
        assert tracemalloc.get_traced_memory()[1] < n * size / 2
    finally:
        tracemalloc.stop()
