"""Byte-level BPE against the public encoder of the same ranks, and round trips."""

import base64
import hashlib
import random

import numpy as np
import pytest

from tidewright.llm import byte_bpe

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
PATH = P.path("byte_bpe_50k.tiktoken")
ALPHABETS = ("ab", "abc \n", "aAbB01 '.,\t\n", "éàüß aeo", "あいう漢字a ", "\x00\x1c\x85　 a1½²", "theraninosd", "😀👍🏽 a", "'sS'tT ll've")


@pytest.fixture(scope="module")
def own():
    return byte_bpe.ByteBpe(PATH, P.PATTERN)


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


def test_short_texts(own, other):
    r = random.Random(3)
    texts = ["".join(r.choice(a) for _ in range(r.randrange(50))) for _ in range(150) for a in ALPHABETS]
    rows = own.encode(texts)
    assert [ids(x) for x in rows] == [other.encode_ordinary(t) for t in texts]
    assert [bytes(x) for x in own.decode(rows)] == [t.encode() for t in texts]
    assert [bytes(x).decode() for x in own.written(rows)] == [" ".join(map(str, other.encode_ordinary(t))) for t in texts]


@pytest.mark.parametrize("alphabet", ["a", "ab", "thean", "é", "漢字"])
def test_very_long_matches(own, other, alphabet):
    r = random.Random(4)
    text = "".join(r.choice(alphabet) for _ in range(40_000))
    assert ids(own.encode([text])[0]) == other.encode_ordinary(text)


def test_the_queue_gives_ranks_in_order():
    q = byte_bpe.RankQueue(300_000)
    ranks = random.Random(5).sample(range(300_000), 500)
    for k in ranks:
        q.mark(k)
    got = []
    while (k := q.lowest()) >= 0:
        got.append(k)
        q.clear(k)
    assert got == sorted(ranks)


def test_worker_memory_is_bounded(own, other, monkeypatch):
    monkeypatch.setattr(byte_bpe, "MEMORY", len(own.known) + 3)
    texts = [f"word{k} x{k}y " * 2 + "z" * 200 for k in range(50)]
    assert [ids(x) for x in own.encode(texts)] == [other.encode_ordinary(t) for t in texts]
    assert len(own.known) <= byte_bpe.MEMORY


def test_unknown_classes_have_no_ascii_form():
    assert byte_bpe.ascii_pattern(r"\p{Lu}+|a") is None
    assert byte_bpe.ascii_pattern(r" ?\p{L}+| ?[^\s\p{L}\p{N}]+") == r" ?[A-Za-z]+| ?[^\sA-Za-z0-9]+"


def test_table_with_odd_rows(spark, other):
    texts = ["It's  a test.\n\n", None, "", " ", "naïve café", "x" * 5000 + " end", "It's  a test.\n\n", "日本語 text 123"]
    rows = [(k if k != 4 else None, t, "other", 1) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens long")
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for k, t, *_ in rows:
        x = other.encode_ordinary(t or "")
        want.append((k, len(x), sha(" ".join(map(str, x)).encode()), sha((t or "").encode())))
    got = [tuple(r) for r in byte_bpe.digest(docs, PATH, P.PATTERN).collect()]
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)
    back = byte_bpe.decode(byte_bpe.encode(docs, PATH, P.PATTERN), PATH, P.PATTERN).collect()
    assert sorted((bytes(r["text"]) for r in back)) == sorted((t or "").encode() for t in texts)
    assert byte_bpe.digest(docs.limit(0), PATH, P.PATTERN).collect() == []
