"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import numpy as np

DEFAULT = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this family of vocabularies cuts a text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Counter:
    """``count`` of tokens of a text, and ``ends``: for each token, the characters of the text up to its end."""

    def __init__(self, path: str) -> None:
        if path.endswith(".tiktoken"):
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.kind, self.t = "ranks", tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        elif path.endswith(".model"):
            import sentencepiece

            self.kind, self.t = "pieces", sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            from tokenizers import Tokenizer

            self.kind, self.t = "json", Tokenizer.from_file(path)
            self.t.encode_special_tokens = True

    def count(self, text: str) -> int:
        text = clean(text)
        if self.kind == "ranks":
            return len(self.t.encode_ordinary(text))
        return len(self.t.encode(text)) if self.kind == "pieces" else len(self.t.encode(text, add_special_tokens=False).ids)

    def ends(self, text: str) -> np.ndarray:
        text = clean(text)
        if self.kind == "json":
            return np.array([e for _, e in self.t.encode(text, add_special_tokens=False).offsets], dtype=np.int64)
        if self.kind == "pieces":
            return np.array([p.end for p in self.t.encode(text, out_type="immutable_proto").pieces], dtype=np.int64)
        sizes = [len(b) for b in map(self.t.decode_single_token_bytes, self.t.encode_ordinary(text))]
        starts = np.cumsum(np.array([len(c.encode()) for c in text] if not text.isascii() else np.ones(len(text), int), dtype=np.int64))
        return np.searchsorted(starts, np.cumsum(sizes), "left") + 1


def clean(text: str) -> str:
    return re.sub("[\ud800-\udfff]", "�", text) if not text.isascii() else text


@lru_cache(4)
def counter(path: str = DEFAULT) -> Counter:
    return Counter(path)
