"""Vocabularies of public tokenizers, read from a folder that is a parameter."""

from __future__ import annotations

import base64
import importlib.util
import os
from functools import lru_cache

#: Split of a text into words before byte pairs merge: the published pattern of the byte-level vocabularies (fixed value).
BYTE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def tokenizer_dir() -> str:
    """BASALT_TOKENIZERS if set, else the installed public_tokenizers, else /opt/tokenizers."""
    if at := os.environ.get("BASALT_TOKENIZERS"):
        return at
    spec = importlib.util.find_spec("public_tokenizers")
    return os.path.dirname(spec.origin) if spec and spec.origin else "/opt/tokenizers"


@lru_cache(maxsize=4)
def byte_ranks(path: str) -> dict[bytes, int]:
    """bytes -> id of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
