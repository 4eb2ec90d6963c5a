"""Encoding of the corpus with a public byte-level BPE tokenizer (problem 8).

The distinct words of a batch form a trie. Sorted order is the trie's depth-first order, so the trie is walked with one
path instead of being stored: each node (a prefix) keeps the last token of its encoding, found from the prefixes before it
(a token that ends the prefix and is compatible with the last token of the rest), and the states of a shared prefix are
computed once. The ids of a word are read back along its path.

Edge cases: null and empty texts have the empty list; texts and words of any length are encoded whole; strings of special
tokens are ordinary text; repeated rows are encoded alike; memory is bounded by the batch and ``CACHE_WORDS``.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Folder of the vocabulary files, and the vocabulary; both are parameters of the functions below.
TOKENIZER_DIR = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words kept with their ids per worker between batches (then forgotten: a speed matter only), and their longest length.
CACHE_WORDS, CACHE_LENGTH = 200_000, 64

#: How the tokenizer cuts a text into words before BPE (part of its published definition).
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class TrieEncoder:
    """Byte-level BPE over a rank table, by last-token states of prefixes."""

    def __init__(self, ranks: dict[bytes, int], word_pattern: str = WORD_PATTERN):
        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self.words = regex.compile(word_pattern)
        self.cache: dict[str, list[int]] = {}
        self._pairs: dict[tuple[int, int], bool] = {}
        self._own: dict[int, bool] = {}

    def _merge(self, data: bytes) -> list[int]:
        """Plain BPE of a short string (two tokens at most): merge the lowest-ranked adjacent pair until none is left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = self.ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _fits(self, before: int, token: int) -> bool:
        key = (before, token)
        if (known := self._pairs.get(key)) is None:
            known = self._pairs[key] = self._merge(self.tokens[before] + self.tokens[token]) == [before, token]
        return known

    def _stands(self, token: int) -> bool:
        if (known := self._own.get(token)) is None:
            known = self._own[token] = self._merge(self.tokens[token]) == [token]
        return known

    def _extend(self, data: bytes, last: list[int], upto: int) -> None:
        """Add the last-token states of the prefixes of ``data`` longer than those in ``last`` (by length)."""
        get = self.ranks.get
        for n in range(len(last) + 1, upto + 1):
            found = -1
            for start in range(max(0, n - self.longest), n):
                token = get(data[start:n])
                if token is not None and (self._stands(token) if start == 0 else self._fits(last[start - 1], token)):
                    found = token
                    break
            last.append(found)

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """Ids of distinct words, by a depth-first walk over their trie."""
        out: dict[str, list[int]] = {}
        path, last = b"", []
        for data, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
            shared = 0
            for a, b in zip(path, data):
                if a != b:
                    break
                shared += 1
            del last[shared:]
            self._extend(data, last, len(data))
            path = data
            ids, n = [], len(data)
            while n:
                token = last[n - 1]
                ids.append(token)
                n -= len(self.tokens[token])
            ids.reverse()
            out[word] = ids
        return out

    def encode_batch(self, texts) -> list[list[int]]:
        split = [self.words.findall(t) if t else [] for t in texts]
        new = {w for ws in split for w in ws} - self.cache.keys()
        fresh = self.encode_words(new) if new else {}
        known = self.cache
        out = []
        for ws in split:
            ids: list[int] = []
            for w in ws:
                ids += known[w] if w in known else fresh[w]
            out.append(ids)
        if len(known) + len(fresh) > CACHE_WORDS:
            known.clear()
        known.update((w, v) for w, v in fresh.items() if len(w) <= CACHE_LENGTH)
        if len(self._pairs) > 4 * CACHE_WORDS:
            self._pairs.clear()
        return out


def read_vocabulary(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> bytes:
    """The vocabulary file, read where the query is made: it travels with the task (under 1 MB), so workers need no copy."""
    with open(os.path.join(folder, vocabulary), "rb") as f:
        return f.read()


@lru_cache(maxsize=4)
def encoder_of(vocabulary: bytes) -> TrieEncoder:
    """One encoder per worker and vocabulary, so that its cache outlives a task."""
    return TrieEncoder({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())})


def load_encoder(folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> TrieEncoder:
    return encoder_of(read_vocabulary(folder, vocabulary))


def encode(text: Column, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Column:
    """Token ids (array<int>, never null) of a text column; no shuffle."""

    data = read_vocabulary(folder, vocabulary)

    @F.pandas_udf(ArrayType(IntegerType(), False))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(data)
        for texts in batches:
            yield pd.Series(encoder.encode_batch(texts), dtype=object)

    return ids(text)


def count_tokens(text: Column, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Column:
    """Number of token ids of a text column (0 for null)."""

    data = read_vocabulary(folder, vocabulary)

    @F.pandas_udf(IntegerType())
    def sizes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = encoder_of(data)
        for texts in batches:
            yield pd.Series([len(x) for x in encoder.encode_batch(texts)], dtype="int32")

    return sizes(text)
