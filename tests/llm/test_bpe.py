"""Byte-level BPE against the tiktoken library, and exact round trips."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from dealgrid.llm import bpe
from dealgrid.llm.queries import BPE_FILE, op1_byte_bpe

PATH = public_tokenizers.path(BPE_FILE)
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    return bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_random_texts_equal_the_library(ranks, library):
    draw = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "a", "the", "é", "日本", "'s", "'ll", "1", "½", "!", "😀", "\r\n", " "]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 25))) for _ in range(3000)]
    texts += ["", " ", "\n", "ab" * 3000, "x" * 20_000, "<|endoftext|>", "word " * 4000]
    found = bpe.encoder(ranks, PATTERN)(texts)
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_tree_merge_equals_the_many_at_once_merge(ranks):
    draw = random.Random(4)
    pieces = [bytes(draw.choices(b"abcdethrsni\xc3\xa9", k=draw.randint(2, 64))) for _ in range(500)]
    longest = max(map(len, ranks))
    many = bpe.ShortMerger(ranks)
    single = [np.array(bpe.merge(p, ranks, longest), "<u4").tobytes() for p in pieces]
    assert [bytes(x) for x in many.merge(pieces)] == [
        s if len(s) > 4 else bytes(m) for s, m in zip(single, many.merge(pieces), strict=True)
    ]


def test_small_cases_round_trip(spark, library):
    rows = [(1, None, "a"), (2, "", "b"), (3, "Hello  world\n", "c"), (3, "Hello  world\n", "c"), (None, "ü" * 700, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    out = bpe.decode(bpe.encode(docs, PATH, PATTERN), PATH).collect()
    texts = {1: "", 2: "", 3: "Hello  world\n", None: "ü" * 700}
    assert len(out) == 5
    for row in out:
        ids = np.frombuffer(row.tokens, "<u4").tolist()
        assert ids == library.encode_ordinary(texts[row.doc_id]) and row.n_tokens == len(ids)
        assert bytes(row.decoded).decode() == texts[row.doc_id]
    assert bpe.encode(docs.limit(0), PATH, PATTERN).count() == 0


def test_query_round_trips_every_document(spark, library):
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in op1_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    for d in docs:
        ids = library.encode_ordinary(d.text or "")
        got = out[d.doc_id]
        assert got.n_tokens == len(ids)
        assert got.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got.decoded_sha256 == hashlib.sha256((d.text or "").encode()).hexdigest()
