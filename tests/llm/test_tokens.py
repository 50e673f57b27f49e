"""Byte-level BPE against tiktoken, and unigram counts against plain dynamic programming."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from lacuna.llm import bpe, token_counts, wordblocks

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["Hello, world! it's  done\n\n now", None, "", " ", "\n\n\n", "日本語 và tiếng Việt \U0001f600‍", "a\x1cb\x85 c d", "x" * 5000, "word " * 3000, "Hello, world! it's  done\n\n now", "<|endoftext|>"]


@pytest.fixture(scope="module")
def ranks():
    with open(RANKS, "rb") as file:
        return bpe.read_ranks(file.read())


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


@pytest.mark.parametrize("block_chars", [1, 40, 10**7])
def test_bpe(spark, ranks, block_chars):
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoded = bpe.encode(docs(spark), RANKS, public_tokenizers.PATTERN, block_chars=block_chars)
    decoded = bpe.decode(encoded, RANKS)
    rows = {r["doc_id"]: r for r in decoded.select("*", *bpe.digests(decoded)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        ids = plain.encode_ordinary(text or "")
        assert rows[i]["ids"] == ids and rows[i]["decoded"] == (text or "").encode() and rows[i]["n_tokens"] == len(ids)
        assert rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()


def test_packing():
    numbers = np.concatenate([np.arange(70_000), [2**32 - 1]]).astype(np.uint32)
    got = wordblocks.unpack_numbers(wordblocks.pack_numbers(numbers, numbers[:0], numbers[:3]))
    assert [g.tolist() for g in got] == [numbers.tolist(), [], [0, 1, 2]]
    words = [b"", b"a", "é".encode() * 300]
    assert wordblocks.unpack_words(wordblocks.pack_words(words)).to_pylist() == words


def test_decode_slices_nulls_and_errors(spark, monkeypatch):
    rows = spark.createDataFrame([(1, [1, 2]), (2, None), (3, [])], "doc_id int, ids array<int>")
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode(rows, RANKS).collect()}
    assert got[2] is None and got[3] == b"" and len(got[1]) == 2
    with pytest.raises(Exception):
        bpe.decode(spark.createDataFrame([(1, [10**6])], "doc_id int, ids array<int>"), RANKS).collect()


def test_empty_table_and_clashing_columns(spark):
    assert bpe.decode(bpe.encode(docs(spark, []), RANKS, public_tokenizers.PATTERN), RANKS).count() == 0
    odd = spark.createDataFrame([(None, "a b", 1, "x")] * 3, "doc_id int, text string, block int, words string")
    assert [len(r["ids"]) for r in bpe.encode(odd, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "block", "words")).collect()] == [2, 2, 2]


def test_token_counts(spark, ranks):
    scores = token_counts.zipf_scores(ranks)

    def plain(word):
        best = [(0.0, 0)]
        for end in range(1, len(word) + 1):
            best.append(max((best[i][0] + scores[word[i:end]], best[i][1] - 1) for i in range(max(0, end - 150), end) if word[i:end] in scores))
        return -best[-1][1]

    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count(docs(spark), RANKS, public_tokenizers.PATTERN).collect()}
    want = {i: sum(plain(m.encode()) for m in regex.findall(public_tokenizers.PATTERN, t or "")) for i, t in enumerate(TEXTS)}
    assert got == want


def test_trie_shares_prefixes(ranks):
    scores = token_counts.zipf_scores(ranks)
    longest = [150] * 256
    trie = token_counts.Trie(scores, longest)
    trie.insert(b"abcdef")
    nodes = len(trie.best)
    trie.insert(b"abcdeg")
    assert len(trie.best) == nodes + 1


def test_documents_of_blocks_do_not_share_buckets(spark, monkeypatch):
    many = docs(spark, [f"text {i}" for i in range(40)]).repartition(8)
    packed = wordblocks.pack_blocks(many, "text", ["doc_id"], public_tokenizers.PATTERN, 64, None, 10**6).select("bucket", "block", "words").collect()
    of_docs = [r["bucket"] for r in packed if r["words"] is None]
    assert len(set(of_docs)) == len({r["block"] for r in packed}) > 1
    assert not set(of_docs) & {r["bucket"] for r in packed if r["words"] is not None}
    asked, pack = [], wordblocks.pack_blocks
    monkeypatch.setattr(wordblocks, "pack_blocks", lambda *a: asked.append(a[4]) or pack(*a))
    for length in (10, 10_000):
        bpe.encode(docs(spark, ["a" * length] * 2), RANKS, public_tokenizers.PATTERN, block_chars=1)
    assert asked == [64, 20_000 // wordblocks.BLOCKS_A_BUCKET]
