"""Byte-level BPE ids of whole texts under a tokenizers file."""

from __future__ import annotations

import json
import os
import re

import numpy as np

END_OF_TEXT = "<|endoftext|>"
#: The byte-level pattern of this kind of vocabulary (fixed value), and what it amounts to where white space stands alone.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PATTERN_LONE_SPACES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: Texts of these characters, where every Unicode table agrees on letters, numbers and spaces.
_PLAIN = re.compile(r"[\n -~¡-ɏ]*")
_PAIR = re.compile(r"[\n ][\n ]")

_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTES = {chr(b): b for b in _SHOWN} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


def ranked(path: str) -> bool:
    """Whether a tokenizers file is byte-level BPE without other steps, whose ids follow the order of its merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, steps = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or steps.get("type") != "ByteLevel" or steps.get("add_prefix_space") or not steps.get("use_regex", True) or spec.get("normalizer") or model.get("dropout"):
        return False
    vocabulary = model["vocab"]
    merged = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    single = [vocabulary.get(c, 1 << 32) for c in _BYTES]
    return merged == sorted(merged) and max(single) < min(merged, default=1 << 32) and all(set(k) <= _BYTES.keys() for k in vocabulary if k != END_OF_TEXT)


class Encoder:
    """Ids equal to those of Tokenizer.encode(text, add_special_tokens=False), as unsigned 32-bit arrays.

    Where the file's ids are merge ranks and it splits texts by PATTERN, plain texts go through tiktoken with the same
    vocabulary; a text with other characters or with the special token's string, and every text of another kind of file,
    goes through tokenizers itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.whole = self.lone = None
        if not ranked(path):
            return
        ranks = {bytes(_BYTES[c] for c in k): v for k, v in self.tokenizer.get_vocab(False).items() if k != END_OF_TEXT}
        self.whole, self.lone = (tiktoken.Encoding(name, pat_str=pat, mergeable_ranks=ranks, special_tokens={}) for name, pat in (("whole", PATTERN), ("lone", PATTERN_LONE_SPACES)))

    def ids(self, text: str) -> np.ndarray:
        if self.whole is None or END_OF_TEXT in text or not _PLAIN.fullmatch(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.asarray((self.whole if _PAIR.search(text) else self.lone).encode_ordinary(text), "<u4")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This Python worker's encoder, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
