"""Token counts under a unigram vocabulary, by dynamic programming over tries of pre-tokens."""

from __future__ import annotations

from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lacuna.llm.bpe import read_ranks
from lacuna.llm.wordblocks import BLOCK_CHARS, per_distinct_word

#: Longer pre-tokens are scored by themselves: a trie would hold a node for each of their bytes.
TRIE_BYTES = 4096
#: Words whose bytes begin alike for so long meet in one trie.
PREFIX_BYTES = 6


def zipf_scores(ranks: dict[bytes, int]) -> dict[bytes, float]:
    """Log-probabilities by Zipf's law: the token of rank r has 1 / (r + 1) of the weight."""
    total = log(sum(1 / (r + 1) for r in ranks.values())) if ranks else 0.0
    return {token: -log(r + 1) - total for token, r in ranks.items()}


@lru_cache(maxsize=2)
def _vocabulary(raw: bytes) -> tuple[dict[bytes, float], list[int]]:
    scores = zipf_scores(read_ranks(raw))
    longest = [0] * 256
    for token in scores:
        longest[token[-1]] = max(longest[token[-1]], len(token))
    return scores, longest


class Trie:
    """Inserted words share the nodes of their prefixes. A node holds the best score of a segmentation of its prefix and how many
    tokens that has, computed once, when the node is made; of equal scores the fewer tokens."""

    def __init__(self, scores: dict[bytes, float], longest: list[int]):
        self.scores, self.longest = scores, longest
        self.child: dict[int, int] = {}
        self.best = [0.0]
        self.tokens = [0]

    def insert(self, word: bytes) -> int:
        """The number of tokens of word, stored at its last node."""
        node, path = 0, [0]
        child, best, tokens, scores, longest = self.child, self.best, self.tokens, self.scores, self.longest
        for end, byte in enumerate(word, 1):
            key = node << 8 | byte
            following = child.get(key)
            if following is None:
                top, least = float("-inf"), 0
                for begin in range(max(0, end - longest[byte]), end):
                    piece = scores.get(word[begin:end])
                    if piece is not None:
                        before = path[begin]
                        score, n = best[before] + piece, tokens[before] + 1
                        if score > top or (score == top and n < least):
                            top, least = score, n
                following = child[key] = len(best)
                best.append(top)
                tokens.append(least)
            node = following
            path.append(node)
        return tokens[node]


def count_words(words: list[bytes], scores: dict[bytes, float], longest: list[int]) -> list[int]:
    trie = Trie(scores, longest)
    return [(trie if len(w) <= TRIE_BYTES else Trie(scores, longest)).insert(w) for w in words]


def count(docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "n_tokens", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The columns keep, and how many tokens (long) the best segmentations of the whole text's pre-tokens have.

    Pre-tokens are the matches of pattern. The vocabulary is the rank file's, scored by zipf_scores(); it has every byte, so
    every pre-token can be segmented. The driver reads it and broadcasts it: its size is a vocabulary's.

    A null or empty text has 0 tokens; repeated rows each give a row; an empty table gives none.
    """
    with open(ranks_path, "rb") as file:
        ranks = docs.sparkSession.sparkContext.broadcast(file.read())

    def resolve(words: pa.Array) -> pa.Array:
        counts = count_words(words.to_pylist(), *_vocabulary(ranks.value))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32)), pa.array(counts, pa.int32()))

    def assemble(lists: pa.ListArray, numbers: np.ndarray, begins: np.ndarray) -> pa.Array:
        sums = np.concatenate([[0], np.cumsum(lists.flatten().to_numpy().astype(np.int64)[numbers])])
        return pa.array(sums[begins[1:]] - sums[begins[:-1]], pa.int64())

    return per_distinct_word(docs, text, list(keep), pattern, resolve, assemble, out, T.LongType(), key_bytes=PREFIX_BYTES, block_chars=block_chars)
