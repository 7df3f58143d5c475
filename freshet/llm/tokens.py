"""Token counts and token borders of texts under a public byte-level tokenizer read from a vocabulary file."""

from __future__ import annotations

import base64
import os
from collections import OrderedDict
from collections.abc import Callable, Hashable
from functools import lru_cache

import numpy as np

#: Vocabulary file; a parameter of every operator that counts tokens.
VOCABULARY = os.environ.get("FRESHET_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the splitting pattern that belongs to this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for text, k in ranks.items():
            self.sizes[k] = len(text)

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def starts(self, text: str) -> np.ndarray:
        """Byte offset of the start of each token, and the end of the text."""
        ids = np.asarray(self.encoding.encode_ordinary(text), np.int64)
        return np.concatenate(([0], np.cumsum(self.sizes[ids]))) if len(ids) else np.zeros(1, np.int64)


@lru_cache(maxsize=4)
def tokenizer(path: str = VOCABULARY) -> Tokenizer:
    return Tokenizer(path)


class Memo:
    """Results of the latest texts, so that copies in one worker are computed once; bounded by the characters kept."""

    def __init__(self, most_chars: int = 4_000_000):
        self.most, self.held, self.kept = most_chars, 0, OrderedDict()

    def get(self, key: Hashable, text: str, make: Callable[[], object]):
        k = (key, text)
        if k in self.kept:
            self.kept.move_to_end(k)
            return self.kept[k]
        value = make()
        if len(text) <= self.most // 8:
            self.kept[k] = value
            self.held += len(text) + 100
            while self.held > self.most:
                old, _ = self.kept.popitem(last=False)
                self.held -= len(old[1]) + 100
        return value


MEMO = Memo()
