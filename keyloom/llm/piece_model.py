"""SentencePiece encoding and decoding by suffix-array matching.

A batch's words are laid out as one text.  Its suffix array is built by doubling; every piece of the vocabulary finds
its range of suffixes by binary search, and each suffix in the range is an edge from its position to where the piece
ends.  Edges sorted by position form a lattice, which is relaxed: a model of merges applies in each word the edge of
the best rank that joins two neighbouring segments, until none does; a unigram model takes the path of the best score.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np

SPACE = "▁"
#: Characters of the words kept in a worker's memo, and of new words indexed at a time.
MEMO_CHARS, INDEX_BYTES = 8_000_000, 1 << 19
#: Longer words, in characters, are relaxed one by one.
LONG_WORD = 64
_WORD = re.compile(" +[^ ]*")


class PieceModel:
    """Vocabulary, scores and kinds of a SentencePiece model file; models of merges (BPE) and unigram models."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        spec = proto.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces:
            raise ValueError("only models without normalisation are supported")
        self.prefix = spec.add_dummy_prefix
        self.merges = proto.trainer_spec.model_type == 2
        kinds = proto.ModelProto.SentencePiece.Type if hasattr(proto, "ModelProto") else sentencepiece_model_pb2.ModelProto.SentencePiece
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        normal = [(p.piece, i, p.score) for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        self.ids = {piece: i for piece, i, _ in normal}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.scores = np.array([p.score for p in proto.pieces], np.float64)
        #: Rank of a merge: 0 is the best score.
        self.rank = np.zeros(len(proto.pieces), np.int64)
        self.rank[[i for _, i, _ in sorted(normal, key=lambda x: (-x[2], x[1]))]] = np.arange(len(normal))
        self.raw = [b""] * len(proto.pieces)
        for piece, i, _ in normal:
            self.raw[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.bytes.items():
            self.raw[i] = bytes([b])
        self.raw[self.unknown] = " ⁇ ".encode()
        #: Words may be cut before each run of spaces if no piece holds a space after something else.
        self.cuts = not any(" " in r.lstrip(b" ").decode() for r in (p.replace(SPACE, " ").encode() for p, _, _ in normal))
        self._order = sorted((p.replace(SPACE, " ").encode(), i) for p, i, _ in normal)
        self._lengths = np.array([len(r) for r, _ in self._order])
        self._piece = np.array([i for _, i in self._order])
        #: By 8-byte block: the pieces that reach into it, and the least and the greatest number that begin like theirs.
        self._blocks = []
        for at in range(0, int(self._lengths.max()), 8):
            own = np.flatnonzero(self._lengths > at)
            part = [self._order[k][0][at : at + 8] for k in own]
            self._blocks.append((at, own, *(np.array([int.from_bytes(x.ljust(8, fill), "big") for x in part], np.uint64) for fill in (b"\0", b"\xff"))))
        self._byte_ids = np.array([self.bytes.get(b, self.unknown) for b in range(256)])
        self.memo: dict[str, bytes] = {}
        self.held = 0

    # -- matching ---------------------------------------------------------------------------------------------

    def edges(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All occurrences of pieces in text: starts, ends and piece ids, sorted by position, then by end."""
        array, keys = suffix_array(text, int(self._lengths.max()))
        low = np.zeros(len(self._order), np.int64)
        high = np.full(len(self._order), len(text), np.int64)
        for at, own, first, last in self._blocks:
            a = bisect(array, keys, at, low[own], high[own], first, False)
            b = bisect(array, keys, at, a, high[own], last, True)
            low[own], high[own] = a, b
        counts = np.maximum(high - low, 0)
        which = np.repeat(np.arange(len(counts)), counts)
        starts = array[np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)]
        ends = starts + self._lengths[which]
        ids = self._piece[which]
        fits = ends <= len(text)
        starts, ends, ids = starts[fits], ends[fits], ids[fits]
        order = np.lexsort((ends, starts))
        return starts[order], ends[order], ids[order]

    # -- encoding ---------------------------------------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """The text with its dummy prefix, cut where no piece reaches across."""
        shown = (" " if self.prefix and text else "") + text.replace(SPACE, " ")
        if not self.cuts:
            return [shown] if shown else []
        found = _WORD.findall(shown)
        head = shown[: shown.find(" ")] if " " in shown else shown
        return [head, *found] if head else found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        split = [self.words(t) for t in texts]
        if self.held > MEMO_CHARS:
            self.memo.clear()
            self.held = 0
        new = list(set().union(*split) - self.memo.keys())
        at = 0
        while at < len(new):
            size, begin = 0, at
            while at < len(new) and (at == begin or size < INDEX_BYTES):
                size += len(new[at])
                at += 1
            self.held += size
            self.memo.update(zip(new[begin:at], self._encode_words(new[begin:at]), strict=True))
        known = self.memo.__getitem__
        return [b"".join(map(known, x)) for x in split]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words that no piece crosses: index, match, sort, relax."""
        raw = [w.encode("utf-8", "replace") for w in words]
        text = b"\0".join(raw) + b"\0"
        starts, ends, ids = self.edges(text)
        flat = np.frombuffer(text, np.uint8)
        first = (flat & 0xC0) != 0x80  # where characters begin
        char = np.cumsum(first) - 1  # of each byte, its character
        begins = np.flatnonzero(first)
        ok = first[starts] & first[np.minimum(ends, len(flat) - 1)] & (flat[starts] != 0)
        a, b, ids = char[starts[ok]], char[ends[ok]], ids[ok]
        lengths = np.array([len(w) for w in words])
        word_at = np.cumsum(lengths + 1) - lengths - 1
        heads, segment = self._relax(a, b, ids, word_at, lengths, len(begins)) if self.merges else self._best_path(a, b, ids, word_at, lengths, len(begins))
        heads[word_at + lengths] = False  # what separates the words
        at = np.flatnonzero(heads)
        found = segment[at].astype(np.int64)
        width = np.append(begins[1:], len(flat))[at] - begins[at]
        count = np.where(found >= 0, 1, width if self.bytes else 1)
        if not self.bytes:  # neighbouring unknown characters of a word are one unknown piece
            again = np.append(False, (found[1:] < 0) & (found[:-1] < 0)) & (np.searchsorted(word_at, at, "right") == np.searchsorted(word_at, np.append(-1, at[:-1]), "right"))
            count[again] = 0
        into = np.cumsum(count)
        row = np.repeat(np.arange(len(at)), count)
        nth = np.arange(len(row)) - np.repeat(into - count, count)
        ids = np.where(found[row] >= 0, found[row], self._byte_ids[flat[begins[at[row]] + nth]] if self.bytes else self.unknown).astype("<u4")
        cuts = np.append(0, into)[np.searchsorted(at, word_at + lengths)] * 4
        raw = ids.tobytes()
        return [raw[x:y] for x, y in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True)]

    def _relax(self, a, b, ids, word_at, lengths, n):
        """Merges in the order of rank, leftmost first; all words take their next merge together."""
        width = int((b - a).max(initial=1))
        table = np.full((n + 1, width + 1), -1, np.int32)  # piece over (character, length)
        table[a, b - a] = ids
        heads = np.ones(n + 1, bool)
        segment = table[:, 1].copy() if width >= 1 else np.full(n + 1, -1, np.int32)
        big = np.iinfo(np.int64).max
        short = np.flatnonzero((lengths <= LONG_WORD) & (lengths > 1))
        # symbols of all short words that still change: their starts, in order, and the word of each
        count = lengths[short]
        word = np.repeat(np.arange(len(short)), count)
        start = np.repeat(word_at[short], count) + np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count)
        stop = start + 1
        while len(start):
            head = np.flatnonzero(np.diff(word, prepend=-1))
            joined = np.append(stop[1:], 0)  # the end of the next symbol
            pair = np.append(word[1:] == word[:-1], False)
            length = np.where(pair, joined - start, 0)
            pair &= length <= width
            piece = np.where(pair, table[start, np.where(pair, length, 0)], -1)
            rank = np.where(piece >= 0, self.rank[piece], big)
            best = np.minimum.reduceat(rank, head)
            group = np.cumsum(np.diff(word, prepend=-1) != 0) - 1
            hit = np.flatnonzero((rank == best[group]) & (rank < big))
            if not len(hit):
                break
            hit = hit[np.diff(group[hit], prepend=-1) != 0]  # the leftmost of each word
            stop[hit] = joined[hit]
            segment[start[hit]] = piece[hit]
            heads[start[hit + 1]] = False
            keep = np.ones(len(start), bool)
            keep[hit + 1] = False
            alive = np.zeros(len(head), bool)
            alive[group[hit]] = True
            keep &= alive[group]
            start, stop, word = start[keep], stop[keep], word[keep]
        for k in np.flatnonzero(lengths > LONG_WORD).tolist():
            self._relax_long(table, segment, heads, int(word_at[k]), int(word_at[k] + lengths[k]), width)
        return heads[:n], segment

    def _relax_long(self, table, segment, heads, begin, end, width):
        """The same for one word, with a heap of the pairs that are edges."""
        after, before = {c: c + 1 for c in range(begin, end)}, {c + 1: c for c in range(begin, end)}
        heap: list[tuple[int, int, int, int]] = []

        def offer(left: int) -> None:
            middle = after[left]
            if middle < end:
                right = after[middle]
                if right - left <= width and (piece := table[left, right - left]) >= 0:
                    heapq.heappush(heap, (int(self.rank[piece]), left, middle, right))

        for c in range(begin, end):
            offer(c)
        while heap:
            _, left, middle, right = heapq.heappop(heap)
            if after.get(left) != middle or after.get(middle) != right:
                continue
            after[left], before[right] = right, left
            del after[middle], before[middle]
            segment[left], heads[middle] = table[left, right - left], False
            offer(left)
            if left > begin:
                offer(before[left])

    def _best_path(self, a, b, ids, word_at, lengths, n):
        """Unigram models: the path of the best total score, over edges in the order of position."""
        unknown = float(self.scores[list(self.ids.values())].min()) - 10
        best = np.full(n + 2, -np.inf)
        via = np.zeros(n + 2, np.int64)
        piece = np.full(n + 2, -1, np.int64)
        best[word_at] = 0
        edges_at = np.searchsorted(a, np.arange(n + 2))
        for at, length in zip(word_at.tolist(), lengths.tolist(), strict=True):
            for c in range(at, at + length):
                single = False
                for e in range(edges_at[c], edges_at[c + 1]):
                    single |= b[e] == c + 1
                    score = best[c] + self.scores[ids[e]]
                    if score > best[b[e]]:
                        best[b[e]], via[b[e]], piece[b[e]] = score, c, ids[e]
                if not single and best[c] + unknown > best[c + 1]:
                    best[c + 1], via[c + 1], piece[c + 1] = best[c] + unknown, c, -1
        heads, segment = np.zeros(n + 1, bool), np.full(n + 1, -1, np.int64)
        for at, length in zip(word_at.tolist(), lengths.tolist(), strict=True):
            c = at + length
            while c > at:
                heads[via[c]], segment[via[c]] = True, piece[c]
                c = int(via[c])
        return heads[:n], segment

    # -- decoding ---------------------------------------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids: pieces joined, byte pieces put together, the dummy prefix off."""
        text = b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


def suffix_array(text: bytes, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions sorted by the `depth` bytes or more that begin there, and of each position its first 8 bytes as a number."""
    n = len(text)
    flat = np.frombuffer(text + bytes(8), np.uint8).astype(np.uint64)
    keys = np.zeros(n, np.uint64)
    for k in range(8):
        keys = (keys << np.uint64(8)) | flat[k : k + n]
    keys = np.append(keys, np.zeros(8 * (-(-depth // 8) + 1), np.uint64))
    order = np.argsort(keys[:n])
    reach, now = 8, keys[:n]
    while reach < depth:
        ranked = now[order]
        names = np.empty(n, np.uint64)
        names[order] = np.cumsum(np.append(False, ranked[1:] != ranked[:-1])).astype(np.uint64) + np.uint64(1)
        if int(names.max()) == n:
            break
        later = np.zeros(n, np.uint64)
        if reach < n:
            later[: n - reach] = names[reach:]
        now = names << np.uint64(32) | later
        order = np.argsort(now)
        reach *= 2
    return order, keys


def bisect(array, keys, offset, low, high, value, right: bool):
    """For each i, where value[i] goes among keys[array + offset] within [low[i], high[i])."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        middle = (low + high) // 2
        found = keys[np.minimum(array[np.minimum(middle, len(array) - 1)] + offset, len(keys) - 1)]
        after = (found <= value if right else found < value) & open_
        low = np.where(after, middle + 1, low)
        high = np.where(open_ & ~after, middle, high)
    return low


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """This Python worker's model, kept from task to task."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode_all(path: str, texts: list[str]) -> Iterator[tuple[bytes, str]]:
    """Ids and decoded text of each text."""
    own = model(path)
    for ids in own.encode(texts):
        yield ids, own.decode(ids)
