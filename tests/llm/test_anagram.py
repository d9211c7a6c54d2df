"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidewright.llm import anagram

LOW = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
SCHEMA = "doc_id long, text string, word string, n long, key long, other string, size int"


def edits(a, b):
    """Whether one insertion, deletion or replacement makes a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))  # noqa: B905
    return a[k + (len(a) == len(b)):] == b[k + 1:]


def brute(rows):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            count[run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 6 and c >= 5}
    near = {w: [u for u in n if edits(w, u)] for w in n}
    form = {}
    for w, us in near.items():
        best = min(us, key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def found(spark, rows):
    docs = spark.createDataFrame([(d, t, "w", 1, 2, "o", 3) for d, t in rows], SCHEMA)
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in anagram.variants(spark, docs).collect()}


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    base = ["receive", "received", "éclair", "éclairs", "ÉCLAIR", "banana", "aaaaaa", "aaaaaab", "letter", "lettre", "straße", "x" * 3000, "mississippi"]
    out = []
    for k in range(400):
        said = []
        for _ in range(12):
            w = r.choice(base[:3] * 40 + base)
            if r.random() < 0.3:
                i, c = r.randrange(len(w)), r.choice("aeinxé")
                w = r.choice([w[:i] + w[i + 1:], w[:i] + c + w[i:], w[:i] + c + w[i + 1:]])
            said.append(w.capitalize() if r.random() < 0.2 else w)
        out.append((k if k % 50 else None, " 1,".join(said)))
    return [*out, (900, None), (901, ""), (902, "12 ._"), (903, "÷×þÿÀà " * 6), *out[:20]]


def test_variants_match_brute_force(spark, rows):
    want = brute(rows)
    assert sum(f is not None for f, *_ in want.values()) > 20
    assert found(spark, rows) == want


def test_chains_of_forms_end_at_their_roots(spark):
    chain = ["chainab", "chainbb", "chainbc", "chaincc", "chaincd"]
    rows = [(k, " ".join([w] * 5 ** (k + 1))) for k, w in enumerate(chain)]
    got = found(spark, rows)
    assert got == brute(rows)
    assert {got[w][1] for w in chain if w in got} == {"chaincd"} and len(got) >= 5


def test_anagrams_do_not_meet_unless_near(spark):
    words = ["abcdefg", "gfedcba", "abcdegf", "abcdef", "bcdefg", "abcdefgg"]
    rows = [(1, " ".join(words * 6))]
    assert found(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert found(spark, []) == {}
