import collections
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veil.llm import sharding, token_counts, token_ids

from .cases import awkward, empty, frame, rows

WORD = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(WORD)


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=50))
@settings(max_examples=100, deadline=None)
def test_ranks_round_trip(values):
    ranks = np.array(values, np.uint32)
    control, data = token_ids.encode_ranks(ranks)
    assert token_ids.decode_ranks(control, data, len(ranks)).tolist() == values


@given(st.lists(st.lists(st.sampled_from(list("abCD éÉßÀ'sTm.,%#-_<|>!1٣ \t\n\x0b\x1c\x85 　́ΣσıİǅK漢ñ") + ["<|endoftext|>", "'ll", "don't"]), max_size=30).map("".join), max_size=5))
@settings(max_examples=200, deadline=None)
def test_chunks_are_encoded_as_whole_texts(texts):
    encode = token_ids.encoder(WORD)
    assert encode.quick
    got = [np.frombuffer(raw, encode.dtype).tolist() for raw in map(encode, texts)]
    assert got == [TOKENIZER.encode(t, add_special_tokens=False).ids for t in texts]


def expected_ids(data):
    start, out = 0, []
    for doc_id, text in sorted(data):
        ids = TOKENIZER.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_files_hold_every_document(spark):
    got = sorted(map(tuple, token_ids.token_report(frame(spark), WORD).collect()))
    assert got == expected_ids(rows())


def test_files_of_awkward_and_empty_tables(spark):
    got = token_ids.token_report(awkward(spark), WORD).collect()
    assert len(got) == awkward(spark).count()
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == list(np.cumsum([0] + [r.n_tokens for r in ordered])[:-1])
    assert [r.doc_id for r in ordered][0] is None and [r.doc_id for r in ordered][1:] == sorted(r.doc_id for r in got if r.doc_id is not None)
    assert token_ids.token_report(empty(spark), WORD).count() == 0


def test_limits_from_the_histogram(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    lengths = [len(token_counts.encoding(path, pattern).encode_ordinary(t or "")) for _, t in rows()]
    answers = token_counts.by_limit(token_counts.histogram(frame(spark), path, pattern)).cache()
    for r in answers.collect():
        n = r.n_tokens
        assert (r.docs, r.tokens) == (lengths.count(n), n * lengths.count(n))
        assert (r.docs_below, r.tokens_below) == (sum(x < n for x in lengths), sum(x for x in lengths if x < n))
        assert (r.docs_at_least, r.tokens_at_least) == (sum(x >= n for x in lengths), sum(x for x in lengths if x >= n))
        assert r.tokens_truncated == sum(min(x, n) for x in lengths) and r.tokens_lost == sum(lengths) - r.tokens_truncated
    limits = [0, 1, 7, 100, 10**7]
    assert {r.limit: r.tokens_truncated for r in token_counts.at_limits(answers, limits).collect()} == {k: sum(min(x, k) for x in lengths) for k in limits}
    half = sorted(lengths)[-(-len(lengths) // 2) - 1]
    assert [r.n_tokens for r in token_counts.quantiles(answers, [0.5]).collect()] == [half]
    assert token_counts.by_limit(token_counts.histogram(empty(spark), path, pattern)).count() == 0


def least_capacity(sizes, shards):
    def fits(c):
        n, own = 1, 0
        for x in sizes:
            if own + x > c:
                n, own = n + 1, 0
            own += x
        return n <= shards

    low, high = max(max(sizes), -(-sum(sizes) // shards)), sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("shards,bins", [(5, 8), (5, 10_000), (1, 4), (40, 30)])
def test_cuts_are_minimax(spark, shards, bins):
    rnd = np.random.default_rng(3)
    sizes = [int(x) for x in np.r_[rnd.integers(1, 50, 150), rnd.integers(1, 2000, 30)]]
    stops = np.cumsum(sizes)
    groups = spark.createDataFrame([(int(a), b) for a, b in zip(stops, sizes)], "stop long, bytes long").cache()
    ends = sharding.cuts(groups, shards, bins)
    assert ends[-1] == sum(sizes) and set(ends) <= {0, *stops.tolist()}
    assert max(np.diff([0, *ends])) == least_capacity(sizes, shards)


def test_shards_law(spark):
    docs = awkward(spark)
    data = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = sharding.sharded(docs, 6).collect()
    key = lambda i, t: (i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(key(i, t) for i, t in data)
    slots, groups = collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        slots[r.shard].append(r.slot)
        groups[r.text_crc32, r.size].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 6
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    assert sharding.sharded(empty(spark)).count() == 0
