from __future__ import annotations

import random
from itertools import chain

import pytest

tiktoken = pytest.importorskip("tiktoken")
pytest.importorskip("public_tokenizers")

from factloom.llm import encoding as E


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P

    ranks = E.read_ranks(E.default_vocabulary())
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return E.Encoder(E.read_ranks(E.default_vocabulary()))


def ids(encoder, texts):
    return [list(chain.from_iterable(p)) for p in encoder.encode_batch(texts)]


def test_every_token_encodes_to_itself_or_as_the_reference(encoder, reference):
    texts = [t.decode() for t in encoder.ranks if all(b < 128 for b in t)]
    assert ids(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


def test_random_texts_of_many_scripts(encoder, reference):
    rnd = random.Random(5)
    alphabet = list("abcE' \n\t\r.,-_()=0189") + ["é", "ß", "中", "国", "한", "ア", "ع", "ת", "😀", "​", "\xa0", "　", "\x85", "\x1c", "\x00", "�", "́", "'s", "'ll", "<|endoftext|>", "  ", "\r\n"]
    texts = ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 80))) for _ in range(4000)]
    assert ids(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


def test_long_runs(encoder, reference):
    texts = ["a" * 3000, " " * 2000 + "x", "\n" * 1500, "ab1" * 1500, "中" * 1200, "=" * 5000, "xyz" + " " * 700]
    assert ids(encoder, texts) == [reference.encode_ordinary(t) for t in texts]


def test_caches_bound_memory_and_change_nothing(reference, monkeypatch):
    monkeypatch.setattr(E, "CACHED", 50)
    small = E.Encoder(E.read_ranks(E.default_vocabulary()))
    texts = [f"word{i} other{i % 7} {i * 31}" for i in range(400)]
    got = [x for k in range(0, 400, 20) for x in ids(small, texts[k : k + 20])]
    assert got == [reference.encode_ordinary(t) for t in texts]
    assert len(small.pieces) < 50 + 20 * 3 + 1


def test_columns(spark, reference):
    texts = ["Hello world", "", None, "<|endoftext|>", "  x\n\n", "Hello world", "a" * 200_000]
    df = spark.createDataFrame([(i // 2, t, "e", [1]) for i, t in enumerate(texts)], "doc_id bigint, text string, tokens string, ids array<int>")
    got = sorted((r.doc_id, list(r.ids)) for r in E.encode_texts(df).collect())
    assert got == sorted((i // 2, reference.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    assert E.encode_texts(df).schema.simpleString() == "struct<doc_id:bigint,ids:array<int>>"
    counts = sorted(tuple(r) for r in E.count_tokens(df, ["doc_id"]).collect())
    assert counts == sorted((i // 2, len(reference.encode_ordinary(t)) if t else 0) for i, t in enumerate(texts))
    assert E.encode_texts(df.limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "x"), (None, None)], "doc_id bigint, text string")
    assert sorted(len(r.ids) for r in E.encode_texts(nulls).collect()) == [0, 1]
