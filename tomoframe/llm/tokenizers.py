"""Public tokenizers, loaded once per Python worker from vocabulary files outside the repository."""

from __future__ import annotations

import base64
import os
from functools import cache

#: Where the vocabulary files are; a parameter of every operator that needs them.
FOLDER = os.environ.get("TOKENIZERS", "/opt/tokenizers")
#: Fixed value: how byte_bpe_50k splits text before its merges.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@cache
def byte_bpe(name: str = "byte_bpe_50k", folder: str = FOLDER):
    """A byte-level tokenizer by tiktoken, and the bytes of each of its ids."""
    import tiktoken

    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    encoding = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    spelled: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        spelled[rank] = token
    return encoding, spelled
