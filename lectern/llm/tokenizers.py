"""Public tokenizers by file; the folder is a parameter, nothing is copied."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

TOKENIZER_DIR = os.environ.get("LECTERN_TOKENIZERS", "/opt/tokenizers")
#: Fixed value: the pre-tokenisation pattern of the byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def byte_bpe(name: str, folder: str = TOKENIZER_DIR):
    """The encoder of ``<folder>/<name>.tiktoken``, loaded once per worker process."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
