"""Phrase collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidewright.llm import collocations

LOW = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
SCHEMA = "doc_id long, lang string, text string, shard long, word string, n long, f long, id long"


def brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOW)):
            ws = re.findall(r"[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                f[lang].update(tuple(ws[i:i + k]) for i in range(len(ws) - k + 1))
    out = {}
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if a >= least}
        longer = Counter()
        for p, a in found.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    longer[p[i:i + m]] = max(longer[p[i:i + m]], a)
        rows_ = []
        for p, a in found.items():
            if len(p) > 1 and 100 * longer[p] < 80 * a:
                score, _, l, r = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), l, r))
        out[lang] = [(k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(rows_)[:top], 1)]
    return {k: v for k, v in out.items() if v}


def found(spark, rows, least, top):
    docs = spark.createDataFrame([(1, lang, t, 5, "w", 6, 7, 8) for lang, t in rows], SCHEMA)
    got = defaultdict(list)
    for r in collocations.collocations(spark, docs.repartition(3), least, top).collect():
        got[r["lang"]].append((r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]))
    return {k: sorted(v) for k, v in got.items()}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(12)
    vocabulary = ["The", "the", "of", "New", "york", "é", "ÉA", "state", "\x00", "a-b", "'", "red", "RED"]
    out = []
    for k in range(300):
        ws = [r.choice(vocabulary) for _ in range(r.randrange(0, 25))]
        if r.random() < 0.5:
            ws[len(ws) // 2:len(ws) // 2] = ["new", "york", "city", "hall"][:r.choice([2, 3, 4])]
        if r.random() < 0.2:
            ws += ["la"] * r.randrange(9)
        out.append((r.choice(["en", "de", None]), "".join(w + r.choice([" ", " ", "\t", "  ", ", ", ".\n", "\r\n", " : "]) for w in ws)))
    return [*out, ("en", None), ("en", ""), (None, " \t. "), ("xx", "too few words"), *out[:40]]


@pytest.mark.parametrize(("least", "top"), [(6, 2000), (12, 3)])
def test_phrases_match_brute_force(spark, rows, least, top):
    want = brute(rows, least, top)
    assert len(want) == 3 and sum(map(len, want.values())) >= 8
    assert found(spark, rows, least, top) == want


def test_phrases_of_many_shards(spark, rows, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", 200)
    monkeypatch.setattr(collocations, "AT_ONCE", 20)
    monkeypatch.setattr(collocations, "SLICE", 3)
    # The settings reach tasks only by what they pickle, so the cutting and counting are called here.
    numbers = collocations._Words()
    text = " ".join(t or "" for _, t in rows).encode()
    parts = collocations.cut_words(text, numbers)
    names = {v: k.decode() for k, v in numbers.items()}
    whole = [names[int(k)] for k in np.concatenate(parts)]
    want = re.findall(r"[^ \t\n]+|\n", re.sub(r"[.,;:!?\n\x0b\x0c\r]", "\n", text.decode().translate(LOW)))
    assert whole == ["\n", *want]
    ids = np.concatenate(parts)
    maps = collocations.Bitmaps(ids, np.arange(len(numbers)) > 0)
    got = Counter()
    for word, block, bits in maps.slices():
        phrase, nxt, _, child = maps.extended(word, block, bits)
        for a, b, n in zip(*collocations.numbered(phrase, nxt, child)[:3]):  # noqa: B905
            got[names[int(a)], names[int(b)]] += int(n)
    pairs = Counter((a, b) for a, b in zip(whole, whole[1:]) if a != "\n" != b)  # noqa: B905
    assert got == pairs


def test_empty_table(spark):
    assert found(spark, [], 30, 2000) == {}
