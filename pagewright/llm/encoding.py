"""Encoding with a public byte-level vocabulary, which is a parameter and never trained here.

The vocabulary is the JSON file that the tokenizers library reads. Where its
ids are merge ranks of plain byte pairs, most texts are encoded by a faster
library from the same file's ranks; that library's pattern matcher gives up on
very long runs of white space, so texts with such runs, and any that it
refuses, are encoded by the JSON form itself. Both give the same ids.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Texts with so many white-space characters in a row are left to the JSON form.
LONG_RUN = 1 << 14
_RUN = re.compile(r"\s{%d}" % LONG_RUN)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def whole(path: str):
    """The vocabulary as its own library reads it."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=2)
def ranked(path: str):
    """The same vocabulary by merge ranks, or None where its ids are not the ranks of its merges."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
    ids = [model["vocab"].get(a + b) for a, b in pairs]
    plain = model.get("type") == "BPE" and not spec.get("normalizer") and not model.get("dropout") and not model.get("ignore_merges")
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or None in ids or ids != sorted(ids):
        return None
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids as uint32; no special tokens are added, but one that stands in a text is its id."""
    fast = ranked(path)

    def by_json(text: str) -> np.ndarray:
        return np.array(whole(path).encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(text: str) -> np.ndarray:
        if len(text) >= LONG_RUN and _RUN.search(text):
            return by_json(text)
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            return by_json(text)

    return by_json if fast is None else encode


def encoded(column: pa.Array, path: str):
    """The ids of each text as uint32; a null text has none."""
    encode = encoder(path)
    for value in column:
        text = value.as_py()
        yield encode(text) if text else np.zeros(0, np.uint32)


@functools.lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level vocabulary stands for."""
    model = whole(path)
    byte = _byte_of()
    tokens = [model.id_to_token(i) for i in range(model.get_vocab_size())]
    return [bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode() for t in tokens]


@functools.lru_cache(maxsize=2)
def plain_encoder(path: str) -> Callable[[str], list[int]]:
    """A function from a text to its ids; strings of special tokens in it are plain text."""
    from tokenizers import Tokenizer

    fast, slow = ranked(path), Tokenizer.from_file(path)
    slow.encode_special_tokens = True

    def by_json(text: str) -> list[int]:
        return slow.encode(text, add_special_tokens=False).ids

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and _RUN.search(text):
            return by_json(text)
        try:
            return fast.encode_ordinary(text)
        except ValueError:
            return by_json(text)

    return by_json if fast is None else encode
