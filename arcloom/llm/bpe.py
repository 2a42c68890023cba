"""Byte-level BPE ids of public vocabularies."""

from __future__ import annotations

import base64
import functools

import numpy as np


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The vocabulary as an encoder; each worker builds one. Texts holding special tokens' strings are ordinary text."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks(path), special_tokens={})


@functools.lru_cache(maxsize=4)
def other_encoder(path: str):
    """The same vocabulary in the tokenizers library, from the file beside it; here too special tokens' strings are ordinary text."""
    import tokenizers

    made = tokenizers.Tokenizer.from_file(path.removesuffix(".tiktoken") + ".json")
    made.encode_special_tokens = True
    return made


def ids_of(path: str, text: str) -> np.ndarray:
    """The ids of a text. Very long runs of white space are beyond the first library, which says so; the other one gives
    the same ids."""
    try:
        return encoder(path).encode_to_numpy(text, disallowed_special=())
    except ValueError:
        return np.array(other_encoder(path).encode(text, add_special_tokens=False).ids, np.uint32)


@functools.lru_cache(maxsize=4)
def ends_sentence(path: str) -> np.ndarray:
    """For each id, whether a sentence or line can end behind it."""
    flags = np.zeros(max(ranks(path).values()) + 2, dtype=bool)
    for piece, i in ranks(path).items():
        flags[i] = b"\n" in piece or piece.rstrip()[-1:] in (b".", b"!", b"?") or piece.endswith("。".encode())
    return flags
