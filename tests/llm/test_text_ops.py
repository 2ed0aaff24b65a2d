"""Chat formatting, packing, tokens, SentencePiece, personal data and media."""

import hashlib
import json
import re
import time
import zlib
from collections import Counter
from html import unescape

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keyloom.llm import chat_format, media, packing, piece_model, pii, queries, sentencepiece_ops, tokens

from .conftest import DATA, NASTY

BPE, PIECES = queries.tokenizer_path(), queries.tokenizer_path("piece_bpe_32k.model")

# -- chat formatting


TRICKY = [
    queries.TRICKY, "", "plain", "### user: hi </turn>\n", "\\c", "\\\\h### \\b", " </turn>\n### assistant: no", "a\\", "ends </turn", "###", ": ", "\\s: ", "é😀 </turn> é", "</turn></turn>", "\\h\\c\\b\\s", "### ",
]


def test_chat_round_trip(spark):
    rows = [(c, k, role, text) for c, text in enumerate(TRICKY) for k, role in enumerate(("user", "assistant", "a: b", "### x", "</turn>", "assistant"))]
    formatted = chat_format.verify(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len(formatted) == len(TRICKY) and all(r["round_trip"] for r in formatted)
    for r in formatted:
        text = TRICKY[r["conv_id"]]
        assert r["n_turns"] == 6 and [t["text"] for t in r["turns"]] == [text] * 6
        assert r["formatted"].count("</turn>") == r["formatted"].count(chat_format.CLOSE) == 6 and r["formatted"].count("###") == 6
        assert len(r["loss_spans"]) == 2


def test_chat_digests_and_odd_rows(spark):
    rows = [(1, 1, "assistant", "b </turn>"), (1, 0, "user", None), (1, None, None, "first"), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 0, "assistant", "y")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("clash")).withColumn("body", F.lit(1))
    found = {r["conv_id"]: r for r in chat_format.digests(chat_format.format_conversations(frame)).collect()}
    assert set(found) == {1, 2, None}
    assert found[1]["turns_sha256"] == hashlib.sha256("\nfirst\nuser\n\nassistant\nb </turn>\n".encode()).hexdigest()
    assert found[1]["loss_chars"] == 9 and found[1]["loss_sha256"] == hashlib.sha256(b"b </turn>").hexdigest()
    assert found[2]["n_turns"] == 2 and found[2]["loss_chars"] == 0 and found[2]["loss_sha256"] == hashlib.sha256(b"").hexdigest()
    assert chat_format.digests(chat_format.format_conversations(frame.limit(0))).count() == 0


# -- tokens and packing


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab 's.,\n\t12é日\x1c\x85　<|>")) | st.characters(codec="utf-8"), max_size=60))
def test_ids_are_the_tokenizers(text):
    own = tokens.encoder(BPE)
    assert own.ids(text).tolist() == own.tokenizer.encode(text, add_special_tokens=False).ids


def test_special_token_in_a_text():
    own = tokens.encoder(BPE)
    assert 50256 in own.ids("a <|endoftext|> b").tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=40), st.integers(30, 40))
def test_fullest_bin_is_fullest(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    if not lengths:
        assert packing.plan(counts, capacity) == {}
        return
    seed = max(lengths)
    rest = Counter(lengths)
    rest[seed] -= 1
    sums = {seed}
    for n in rest.elements():
        sums |= {s + n for s in sums if s + n <= capacity}
    chosen = packing.fullest(counts, seed, capacity)
    assert sum(chosen) == max(sums) and not Counter(chosen) - Counter(lengths)


def check_packed(rows, texts, capacity):
    encode = tokens.encoder(BPE).ids
    own: dict = {}
    for r in rows:
        own.setdefault(r["doc_id"], []).append(r)
    for doc, text in texts.items():
        ids = np.append(encode(text or ""), 0).astype("<u4")
        pieces = sorted(own[doc], key=lambda r: r["piece"])
        assert [r["piece"] for r in pieces] == list(range(len(pieces))) and sum(r["length"] for r in pieces) == len(ids)
        at = 0
        for r in pieces:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert all(r["length"] == capacity for r in pieces[1:])
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_packing(spark, docs):
    texts = {i: t for i, t in enumerate([*NASTY, *("some words here " * k for k in range(1, 60))])}
    for capacity in (64, 2048):
        rows = packing.pack(docs(texts.items()).repartition(3), BPE, capacity).collect()
        bins = check_packed(rows, texts, capacity)
        assert bins <= 1.05 * sum(r["length"] for r in rows) / capacity + 1
    assert packing.pack(docs([]), BPE).count() == 0


def test_packing_query(spark):
    rows = queries.op10_best_fit_packing(spark, DATA).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    bins = check_packed(rows, texts, 2048)
    assert bins <= sum(r["length"] for r in rows) / 2048 + 2


# -- SentencePiece


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("abt he▁ \n\té日本")) | st.characters(codec="utf-8"), max_size=90), max_size=4))
def test_pieces_are_the_librarys(texts):
    import sentencepiece

    library, own = sentencepiece.SentencePieceProcessor(model_file=PIECES), piece_model.model(PIECES)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), text
        assert own.decode(ids) == library.decode(library.encode(text))


def test_unigram_relaxation_finds_the_best_path(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(PIECES, "rb").read())
    del proto.pieces[:]
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("▁", -3, 1), ("a", -2.5, 1), ("b", -2.6, 1), ("ab", -3.1, 1), ("ba", -4, 1), ("▁a", -3.3, 1), ("aba", -4.4, 1), ("▁ab", -5.1, 1)]:
        proto.pieces.add(piece=piece, score=score, type=kind)
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback, proto.trainer_spec.vocab_size = 1, False, len(proto.pieces)
    path = str(tmp_path / "u.model")
    open(path, "wb").write(proto.SerializeToString())
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), piece_model.PieceModel(path)
    texts = ["ab", "abab", "aab ba", "b", "xa xx b", "abba ab", "ababab"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [library.encode(t) for t in texts]


def test_suffix_array_and_matches():
    text = b"banana band\0nab\0"
    order, _ = piece_model.suffix_array(text, 16)
    assert [text[i : i + 16].ljust(16, b"\0") for i in order] == sorted(text[i : i + 16].ljust(16, b"\0") for i in range(len(text)))
    own = piece_model.model(PIECES)
    starts, ends, ids = own.edges(text)
    found = set(zip(starts.tolist(), ends.tolist(), ids.tolist(), strict=True))
    pieces = {p.replace("▁", " ").encode(): i for p, i in own.ids.items()}
    assert found == {(a, b, pieces[text[a:b]]) for a in range(len(text)) for b in range(a + 1, len(text) + 1) if text[a:b] in pieces}


def test_sentencepiece_tables(spark, nasty):
    encoded = sentencepiece_ops.encode(nasty, PIECES)
    back = [(r["doc_id"], r["text"]) for r in sentencepiece_ops.decode(encoded, PIECES).collect()]
    assert sorted(back, key=repr) == sorted(((r["doc_id"], r["text"] or "") for r in nasty.collect()), key=repr)
    assert all(r["same"] for r in sentencepiece_ops.round_trip(nasty, PIECES).collect())
    assert sentencepiece_ops.round_trip(nasty.limit(0), PIECES).count() == 0


def test_sentencepiece_query(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op4_sentencepiece(spark, DATA).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


# -- personal data

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_base(text):
    out = []
    for k, (kind, rule) in enumerate(RULES.items()):
        for m in re.finditer(rule, text):
            digits = re.sub("[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == "card" and not (13 <= len(digits) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((k, m.start(), m.end()))
    return out


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a@.-+ 0123456789()é", max_size=80))
def test_base_spans_are_those_of_the_patterns(text):
    assert sorted(pii.base_spans(text)) == sorted(plain_base(text))


def spent(text):
    began = time.process_time()
    pii.propose(text)
    return time.process_time() - began


@pytest.mark.parametrize("unit", ["1", "a", "a@", "1.", "+1", "+1 ", "9 ", "10.1.2.3 0123456789 ", "a@b.cc James Miller ", "Ab ", "a-b/c1", "123-45-6789 ", "(212) 234-5678 ", "AB12 3456 ", "Mr "])
def test_time_is_linear(unit):
    """Eight times the text takes no more than some fifteen times as long; a quadratic scan takes sixty-four times."""
    short, long = unit * (40_000 // len(unit)), unit * (320_000 // len(unit))
    spent(short)
    assert min(spent(long) for _ in range(2)) < 20 * max(0.004, min(spent(short) for _ in range(3)))


def test_labelers_vote_on_what_others_propose():
    """No labeler always agrees with the proposal: each kind has spans that each of them is for, against or silent on."""
    texts = [
        "Dear James Miller said", "Of The Month", "Anna Anna went", "see page Rosa Parkson",
        "token 0a1b2c3d4e5f60718293a4b5c6d7e8f9", "ghp_0123456789abcdefABCD", "commit aaaaaaaaaaaaaaaaaaaaaaa1", "path/to/some/thing_of_mine/file7", "aaaaaaaaaaaaaaaaaaaaaaaaa0b",
        "ssn 212-45-1234", "part 900-45-1234", "078-05-1120", "666 12 1234", "call 212-234-5678", "id 011-234-5678", "800-234-5678", "account 48210034", "20240131", "DE89370400440532013000", "page DE89370400440532013001", "11111111",
    ]
    seen = {kind: [set(), set(), set()] for kind in pii.ADDED}
    for text in texts:
        for kind, _, _, votes, _ in pii.propose(text)[1]:
            for own, v in zip(seen[pii.KINDS[kind]], votes, strict=True):
                own.add(v)
    assert all(len(own) > 1 for kinds in seen.values() for own in kinds), seen


def test_reliabilities_trust_labelers_that_agree():
    likely, rates = pii.reliabilities({"+++": 60, "++0": 20, "---": 70, "--0": 10, "++-": 5, "--+": 5})
    assert likely["+++"] > 0.95 and likely["---"] < 0.05 and likely["++-"] > likely["--+"]
    assert min(rates[0]) > 0.8


def test_reliabilities_are_found_again():
    """Votes drawn from known rates: EM finds the rates, and the share of personal data."""
    rng = np.random.default_rng(0)
    real, silent = [(0.9, 0.8), (0.85, 0.95), (0.9, 0.75)], (0.1, 0.4, 0.5)
    counts = Counter()
    for _ in range(20_000):
        yes = rng.random() < 0.3
        counts["".join("0" if rng.random() < gone else "+" if (rng.random() < (own[0] if yes else 1 - own[1])) else "-" for own, gone in zip(real, silent, strict=True))] += 1
    likely, rates = pii.reliabilities(counts)
    assert abs(sum(likely[p] * n for p, n in counts.items()) / 20_000 - 0.3) < 0.03
    assert np.abs(np.array(rates) - real).max() < 0.05


def test_votes_against_lower_the_posterior():
    for head in ("0+", "++", "+0", "00"):
        likely, _ = pii.reliabilities({head + "+": 10, head + "0": 1000, head + "-": 50})
        assert likely[head + "+"] > likely[head + "0"] > likely[head + "-"]
    alone, _ = pii.reliabilities({"000": 500})
    assert alone["000"] < 0.5
    split, _ = pii.reliabilities({"++0": 300, "--0": 700, "+-0": 40, "+--": 40})
    assert split["++0"] > 0.9 > 0.1 > split["--0"] and split["+--"] < split["+-0"]


def test_pii_on_odd_rows(spark, docs, nasty):
    found = pii.find(nasty).collect()
    assert len(found) == nasty.count() and all(r["spans"] == "" for r in found)
    secret = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567"
    texts = [f'x{i} token = "{secret}" and James Miller, mail a{i}@b.com' for i in range(30)] + [f"see page commit {'ab' * 15}{i} nothing" for i in range(30)]
    rows = {r["doc_id"]: r for r in pii.find(docs(enumerate(texts))).collect()}
    assert all("email" in rows[i]["spans"] and "secret" in rows[i]["spans"] and "name" in rows[i]["spans"] for i in range(30))
    assert rows[0]["n_email"] == 1
    masked = {r["doc_id"]: r["text"] for r in pii.mask(docs(enumerate(texts))).collect()}
    assert masked[0] == 'x0 token = "[SECRET]" and [NAME], mail [EMAIL]'
    assert pii.mask(nasty).columns == nasty.columns and pii.find(nasty.limit(0)).count() == 0


def test_pii_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in queries.op1_pii(spark, DATA).collect():
        base = plain_base(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in RULES] == [sum(x[0] == k for x in base) for k in range(4)]
        written = ",".join(f"{list(RULES)[k]}:{a}:{b}" for k, a, b in sorted(base))
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest() and set(filter(None, written.split(","))) <= set(r["spans"].split(","))


def test_planted_spans_are_found(spark, docs):
    """Precision and recall of the added spans on planted data, against decoys of the same shapes."""
    rng = np.random.default_rng(3)
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    names, planted, pairs = sorted(pii.FIRST_NAMES), {}, []
    for i in range(400):
        first, last = rng.choice(names), rng.choice(["Miller", "Okafor", "Dubois", "Schmidt", "Larsen", "Quintero"])
        good = [
            ("name", "signed by ", f"{first} {last}"), ("secret", 'token = "', hexes(40)), ("ssn", "social security ", f"{rng.integers(101, 665)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}"),
            ("local", "call ", f"{rng.integers(201, 499)}-{rng.integers(201, 499)}-{digits(4)}"), ("account", "bank account ", f"4{digits(8)}"),
        ][i % 5]
        bad = [
            ("", "In The Morning"), ("commit ", "a" * 24 + str(i)), ("part ", f"9{digits(2)}-{digits(2)}-{digits(4)}"), ("order ", f"011-1{digits(2)}-{digits(4)}"), ("year ", f"20{rng.integers(10, 25)}0{rng.integers(1, 9)}1{rng.integers(0, 9)}"),
        ][int(rng.integers(5))]
        head = f"plain words {bad[0]}{bad[1]} , and then some words about nothing much , {good[1]}"
        pairs.append((i, f"{head}{good[2]} , more words"))
        planted[i] = f"{good[0]}:{len(head)}:{len(head) + len(good[2])}"
    found = {r["doc_id"]: set(filter(None, r["spans"].split(","))) for r in pii.find(docs(pairs)).collect()}
    hits = sum(planted[i] in found[i] for i in planted)
    assert hits / len(planted) > 0.95, Counter(planted[i].partition(":")[0] for i in planted if planted[i] not in found[i])
    assert hits / sum(map(len, found.values())) > 0.95, Counter(x.partition(":")[0] for i in planted for x in found[i] - {planted[i]})


# -- media


def test_pages_become_items():
    html = '<html><head><script>var t="</p>";</script></head><body>one <b>two</b><figure><img src="sha256:abc" alt="A"><figcaption>cap &amp; tion</figcaption></figure><p>three</p><img src="x.png" alt="B"><p></p>four'
    assert [(x["position"], x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.parse_page(html)] == [(0, "text", "one two", None), (1, "media", "abc", "cap & tion"), (2, "text", "three", None), (3, "media", "x.png", "B"), (4, "text", "four", None)]
    assert media.parse_page(None) == [] == media.parse_page("") and media.parse_page("<p") is not None
    assert media.reference("data:image/png;base64,YQ==") == hashlib.sha256(b"a").hexdigest() and media.reference("data:x;base64,?") is not None


def shown(html):
    return [(x["kind"], x["text"] or x["ref"], x["caption"]) for x in media.parse_page(html)]


def test_captions_before_without_and_after_media():
    assert shown('<figure><figcaption>cap</figcaption><img src="a" alt="A"></figure>') == [("media", "a", "cap")]
    assert shown("one<figure><figcaption>cap</figcaption></figure>two") == [("text", "one", None), ("text", "cap", None), ("text", "two", None)]
    assert shown('<figure><img src="a"><figcaption>c<p>d</p></figcaption></figure>e') == [("media", "a", "c d"), ("text", "e", None)]
    assert shown('<figure><img src="a"><figcaption>cap</figure><p>rest</p><img src="b">') == [("media", "a", "cap"), ("text", "rest", None), ("media", "b", None)]
    assert shown('<figure><img src="a"><figcaption>cap<p>rest</p>more<img src="b" alt="B">') == [("media", "a", "cap"), ("text", "rest", None), ("text", "more", None), ("media", "b", "B")]
    assert shown('<figure><figcaption>cap</figcaption><img src="a"><p>rest</p><img src="b" alt="B">') == [("media", "a", "cap"), ("text", "rest", None), ("media", "b", "B")]
    nested = '<figure><img src="a"><figure><img src="b"><figcaption>in</figcaption></figure><figcaption>out</figcaption></figure>'
    assert shown(nested) == [("media", "a", "out"), ("media", "b", "in")]
    assert shown("a<template>x<template>y</template>z</template>b<script>if (a<b) c</script>d") == [("text", "abd", None)]
    assert shown('<figcaption>no figure</figcaption></figure><img src="a">') == [("text", "no figure", None), ("media", "a", None)]


def test_the_drivers_pages(spark):
    """Every word of a page's visible text comes once and in order, by a plain reading of the tags; a picture put into each page comes at its place."""
    pages = spark.read.parquet(f"{DATA}/pages.parquet").withColumn("html", F.regexp_replace("html", "<h1>", '<img src="p1" alt="a picture"><h1>'))
    rows = {r["page_id"]: r["html"] for r in pages.collect()}
    stored = spark.createDataFrame([("p1", b"P5\n64 1\n255\n" + bytes(64))], "digest string, media binary")
    found: dict = {}
    for r in media.interleave(pages, stored, payloads=True).orderBy("page_id", "position").collect():
        found.setdefault(r["page_id"], []).append(r)
    for page_id, html in rows.items():
        own = found.get(page_id, [])
        assert [r["position"] for r in own] == list(range(len(own)))
        plain = lambda part: "".join(unescape(re.sub(r"(?s)<(script|style|template)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ", part)).split())
        assert "".join("".join(x["text"] or "" for x in own).split()) == plain(html)
        pictures = [r for r in own if r["kind"] == "media"]
        assert len(pictures) == html.count("<h1>") and all(r["media"]["payload"] == bytes(64) and r["caption"] == "a picture" for r in pictures)
        for picture in pictures[:1]:
            before = "".join("".join(x["text"] or "" for x in own[: picture["position"]]).split())
            assert before == plain(html.partition("<img")[0])


def test_payloads_by_digest(spark):
    image = lambda k: b"P5\n64 1\n255\n" + bytes([k]) * 64
    pages = spark.createDataFrame([(k, f'<p>t{k}</p><img src="sha256:d{k % 3}">') for k in range(3000)] + [(3000, '<img src="sha256:d0">' * 1500)], "page_id long, html string")
    rows = media.interleave(pages, spark.createDataFrame([("d0", image(0)), ("d1", image(1)), ("d1", image(1))], "digest string, media binary"), payloads=True)
    by = {(r["page_id"], r["position"]): r["media"] for r in rows.collect()}
    assert len(by) == 7500 and by[3000, 1499]["payload"] == bytes(64) and by[4, 1]["payload"] == bytes([1]) * 64 and by[5, 1] is None and by[4, 0] is None


def test_pages_are_parsed_once(spark):
    plan = media.documents_as_media(spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan.rpartition("== Physical Plan ==")[2]  # references and what was read are written tables


def test_interleave_keeps_positions_and_unresolved_references(spark):
    pages = spark.createDataFrame([(1, '<p>a</p><img src="sha256:d1" alt="c1"><img src="sha256:d2">', "x"), (2, None, "y"), (3, '<img src="sha256:d1">' * 3, "z")], "page_id long, html string, media string")
    image = b"P5\n64 1\n255\n" + bytes(range(64))
    rows = media.interleave(pages, spark.createDataFrame([("d1", image), ("d1", image), ("d3", b"no"), ("d4", None)], "digest string, media binary")).orderBy("page_id", "position").collect()
    assert [(r["page_id"], r["position"], r["kind"], r["caption"], r["media"] is not None) for r in rows] == [(1, 0, "text", None, False), (1, 1, "media", "c1", True), (1, 2, "media", None, False), (3, 0, "media", None, True), (3, 1, "media", None, True), (3, 2, "media", None, True)]
    assert rows[1]["media"]["payload_sha256"] == hashlib.sha256(bytes(range(64))).hexdigest()
    assert media.interleave(pages.limit(0), spark.createDataFrame([], "digest string, media binary")).count() == 0


def expected_media(text):
    raw = (text or "").encode()
    payload = raw + bytes((-len(raw)) % 64 or (0 if raw else 64))
    image = f"P5\n64 {len(payload) // 64}\n255\n".encode() + payload
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(image), hashlib.sha256(image).hexdigest()


def test_documents_as_media(spark, nasty):
    columns = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    rows = media.documents_as_media(nasty).collect()
    assert sorted(((r["doc_id"], *(r[c] for c in columns)) for r in rows), key=repr) == sorted(((r["doc_id"], *expected_media(r["text"])) for r in nasty.collect()), key=repr)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    found = queries.op9_media_columns(spark, DATA).collect()
    assert len(found) == len(texts) and all(tuple(r[c] for c in columns) == expected_media(texts[r["doc_id"]]) for r in found)
    same: dict = {}
    for r in found:
        assert same.setdefault(r["payload_sha256"], r["feature"]) == r["feature"]
    assert json.dumps(found[0]["feature"])
    with pytest.raises(ValueError):
        media.read_image(b"P5\n64 2\n255\nshort")
