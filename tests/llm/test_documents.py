"""Operators on documents against brute force on small tables with odd rows."""

import glob
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidewright.llm import bin_slack, candidates, license_scan, line_dedup, mixing, odd_sketch, suffix_tree, toxicity
from tidewright.llm.common import Scratch

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, source string, row long, key long, id long, c long"
ASCII = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def docs_of(spark, texts, sources=None):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, sources[k] if sources else "s", 1, 2, 3, 4) for k, (i, t) in enumerate(texts)], SCHEMA)


def prose(r, n):
    return " ".join(r.choice(["al", "be", "cor", "dem", "ef", "gha"]) + r.choice(["ta", "no", "ri"]) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Copies, near copies, nulls, blanks, a very long text, repeated rows and rows without doc_id."""
    r = random.Random(7)
    out = []
    for k in range(40):
        words = prose(r, r.randrange(3, 120)).split()
        for _ in range(r.choice([1, 1, 1, 6])):
            w = list(words)
            for _ in range(r.randrange(0, 1 + len(w) // 9)):
                w[r.randrange(len(w))] = "x" + str(r.randrange(9))
            out.append((len(out) * 3, " ".join(w)))
    out += [(501, None), (502, ""), (503, " \n\t "), (504, "One"), (505, "oNE "), (506, prose(r, 30_000)), (507, "a  b\nc"), (508, "A b c")]
    return out


def components(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII))
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_match_all_pairs(spark, texts, n):
    got = {r["doc_id"]: r for r in odd_sketch.near_duplicates(spark, docs_of(spark, texts), n, 80).collect()}
    sets = {i: shingles(t, n) for i, t in texts}
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = components(ids, links)
    assert links and {i: got[i]["component_id"] for i in ids} == want
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (want[i] == i) for i in ids)


@pytest.mark.parametrize("words", [1, 2, 3, 4, 5])
def test_near_duplicates_of_one_short_document(spark, words):
    got = odd_sketch.near_duplicates(spark, docs_of(spark, [(3, "a b c d e"[:2 * words - 1])]), 5, 80).collect()
    assert [(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got] == [(3, 1, 3, True)]


def test_bucket_leaders_deal_out_a_hot_key(spark):
    rows = [*[(7, i) for i in range(4000)], (7, 11), *[(k, i) for k in range(100, 160) for i in range(k % 4)], (8, 3), (8, 3)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = candidates.bucket_leaders(spark.createDataFrame(rows, "key long, id long"), Scratch(spark, "leaders"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = defaultdict(set)
    for k, i in rows:
        want[k].add(i)
    have, lead = defaultdict(list), defaultdict(set)
    for r in got.collect():
        have[r["key"]].append(r["id"])
        lead[r["key"]].add(r["leader"])
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items() if len(v) > 1}
    assert all(len(lead[k]) == 1 and lead[k] <= want[k] for k in have)
    held = [r["count"] for r in got.where("key = 7").groupBy(F.input_file_name()).count().collect()]
    assert sum(held) == 4000 and max(held) < 2000  # no task wrote the whole key


def test_near_duplicates_of_odd_tables(spark, texts):
    assert odd_sketch.near_duplicates(spark, docs_of(spark, [])).count() == 0
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (9, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (7, "q"), (7, "a b c d e f")]
    got = odd_sketch.near_duplicates(spark, docs_of(spark, rows), 2, 80).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [(4, 4, True), (4, 4, True), (7, 4, False), (7, 4, False), (9, 4, False)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2


def test_rows_that_share_a_doc_id_are_linked_by_any_text(spark):
    r = random.Random(31)
    near = lambda t: " ".join(w if k else "x" for k, w in enumerate(t.split()))
    base = {k: prose(r, 150) for k in range(100, 112)}
    rows = list(base.items()) + [(k - 90, prose(r, 150)) for k in base] + [(k - 90, near(t)) for k, t in base.items()]
    for order in (rows, rows[::-1]):
        got = {(x["doc_id"], x["component_id"], x["kept"]) for x in odd_sketch.near_duplicates(spark, docs_of(spark, order), 2, 80).collect()}
        assert got == {(k, k - 90, False) for k in base} | {(k - 90, k - 90, True) for k in base}


def test_a_large_group_of_near_copies(spark):
    """More members than one block holds: still one component, and a text apart stays apart."""
    r = random.Random(3)
    base = prose(r, 60).split()
    rows = [(900, prose(r, 60))]
    for k in range(700):
        w = list(base)
        for j in r.sample(range(60), 2):
            w[j] = f"y{k}-{j}"
        rows.append((k, " ".join(w)))
    got = {x["doc_id"]: x["component_id"] for x in odd_sketch.near_duplicates(spark, docs_of(spark, rows), 2, 80).collect()}
    sets = {i: shingles(t, 2) for i, t in rows}
    ids = sorted(sets)
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want = components(ids, [(a, b) for a in ids for b in ids if a < b and near(a, b)])
    assert got == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    r = random.Random(5)
    for _ in range(1500):
        a = bytes(r.choice(b"ab") for _ in range(r.randrange(9)))
        b = bytearray(a)
        for _ in range(r.randrange(4)):
            if r.random() < 0.4:
                b.insert(r.randrange(len(b) + 1), r.choice(b"abc"))
            elif b and r.random() < 0.5:
                del b[r.randrange(len(b))]
            elif b:
                b[r.randrange(len(b))] = r.choice(b"abc")
        for k in range(4):
            assert line_dedup.within(a, bytes(b), k) == (distance(a, bytes(b)) <= k)


def test_every_close_pair_of_lines_shares_a_key():
    from tidewright.llm.common import prefix_hash
    r = random.Random(6)
    for _ in range(300):
        a = bytes(r.choice(b"abcd") for _ in range(r.randrange(7, 30)))
        b = bytearray(a)
        for _ in range(2):
            op, at = r.randrange(3), r.randrange(len(b))
            if op == 0:
                b.insert(at, r.choice(b"abcd"))
            elif op == 1:
                del b[at]
            else:
                b[at] = r.choice(b"abcd")
        whole = np.frombuffer(a + bytes(b), np.uint8)
        keys, line = line_dedup.segment_keys(prefix_hash(whole), np.array([0, len(a)]), np.array([len(a), len(whole)]), 2)
        assert set(keys[line == 0]) & set(keys[line == 1])


def test_line_copies(spark):
    r = random.Random(8)
    lines = [prose(r, 8) for _ in range(25)]
    edited = []
    for x in lines[:8]:
        at = r.randrange(len(x))
        edited.append(x[:at] + "é" * (at % 2) + x[at + 1:])
    middling = ["of a length for equal lines", "of a length for equal linez"]
    rows = []
    for k in range(60):
        rows.append((1000 - k, "\n".join(r.choice(lines + edited + middling + ["short", ""]) for _ in range(r.randrange(1, 7)))))
    rows += [(None, lines[0]), (2000, None), (2001, ""), (2002, lines[1] + "\n" + lines[1]), (2003, prose(r, 9000))]
    got = {(x["doc_id"]): x for x in line_dedup.drop_copies(spark, docs_of(spark, rows)).collect()}
    place = defaultdict(list)
    order = lambda i: (i is None, i or 0)
    for i, t in rows:
        for k, x in enumerate((t or "").split("\n")):
            if t is not None and len(x.encode()) >= line_dedup.EXACT_BYTES:
                place[x].append((order(i), k))
    known = sorted(place)
    long = [x for x in known if len(x.encode()) >= line_dedup.MIN_BYTES]
    up = components(known, [(a, b) for a in long for b in long if a < b and abs(len(a) - len(b)) < 3 and distance(a.encode(), b.encode()) <= 2])
    first = defaultdict(lambda: ((True, 9e9), 0))
    for x in known:
        first[up[x]] = min(first[up[x]], *place[x]) if first[up[x]][0][1] != 9e9 else min(place[x])
    for i, t in rows:
        if t is None:
            assert got[i]["text"] is None and (got[i]["n_lines"], got[i]["n_dropped"]) == (0, 0)
            continue
        kept = [x for k, x in enumerate(t.split("\n")) if len(x.encode()) < line_dedup.EXACT_BYTES or first[up[x]] == (order(i), k)]
        assert got[i]["text"] == "\n".join(kept)
        assert (got[i]["n_lines"], got[i]["n_dropped"]) == (t.count("\n") + 1, t.count("\n") + 1 - len(kept))
    assert line_dedup.drop_copies(spark, docs_of(spark, [])).count() == 0
    clash = docs_of(spark, [(1, lines[0]), (2, lines[0])]).selectExpr("doc_id", "text", "1 as gone", "2 as t", "3 as mark", "4 as row", "5 as n_dropped")
    assert [(x["gone"], x["t"], x["mark"], x["row"], x["n_dropped"]) for x in line_dedup.drop_copies(spark, clash).orderBy("doc_id").collect()] == [(1, 2, 3, 4, 0), (1, 2, 3, 4, 1)]
    assert set(docs_of(spark, []).columns) < set(line_dedup.drop_copies(spark, docs_of(spark, [])).columns)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    return path, Tokenizer.from_file(path)


def test_packing_round_trip(spark, texts, tokenizer):
    path, tok = tokenizer
    rows = [*texts, (None, "x <|endoftext|> y"), (3, "again"), (601, "it's A.B. ΣΑΣ é1!? \x1c,")]
    for window in (64, 2048):
        got = bin_slack.pack(spark, docs_of(spark, rows), path, window).collect()
        pieces = defaultdict(list)
        for p in got:
            pieces[p["doc_id"], p["doc_tokens"]].append(p)
        for i, t in rows:
            ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
            want = sorted((s, len(ids[s:s + window]), zlib.crc32(ids[s:s + window].tobytes())) for s in range(0, len(ids), window))
            have = {(p["start"], p["length"], p["ids_crc32"]) for p in pieces[i, len(ids)]}
            assert set(want) <= have
        assert sum(p["length"] for p in got) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
        at = defaultdict(list)
        for p in got:
            at[p["sequence_id"]].append((p["offset"], p["length"]))
        for s in at.values():
            ends = 0
            for offset, length in sorted(s):
                assert offset == ends
                ends += length
            assert ends <= window
        assert len(at) <= sum(p["length"] for p in got) / window * 1.1 + 2
    assert bin_slack.pack(spark, docs_of(spark, []), path).count() == 0


def test_fullest_window_is_the_closest():
    r = random.Random(2)
    for _ in range(60):
        counts = {r.randrange(1, 30): r.randrange(1, 4) for _ in range(6)}
        used = bin_slack.fullest(counts, 50)
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * j for s in sums for j in range(n + 1) if s + k * j <= 50}
        assert sum(k * n for k, n in used.items()) == max(sums) and all(n <= counts[k] for k, n in used.items())


def test_license_scan(spark):
    rows = [(1, "All  RIGHTS-reserved. cc/by; CC BY-NC general public\nlicense"), (2, None), (3, ""), (4, "all rights all rights reserved rights"), (None, "cc by"), (5, "Kennen liKense general public liKense"),
            (6, "This work is licensed under (the) GNU General Public License, version 3"), (7, "word " * 20_000 + "all rights reserved"), (6, "cc by"), (8, "permission is hereby granted free of charge, to anyone obtaining copy of this software and associated documentation files")]
    spans, result = license_scan.scan(spark, docs_of(spark, rows))
    got = sorted(result.collect(), key=lambda r: (str(r["doc_id"]), r["n_words"]))
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(ASCII))
        at = [(k, label) for label, p in license_scan.PHRASES for k in range(len(w)) if w[k:k + len(p.split())] == p.split()]
        want.append((i, len(w), len(at), min(at)[0] if at else None, max(at)[0] if at else None, ",".join(sorted({x for _, x in at}))))
    assert [tuple(r)[:6] for r in got] == sorted(want, key=lambda r: (str(r[0]), r[1]))
    assert all(0 <= r["score"] <= 1 and set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) for r in got)
    assert "mit" in next(r["labels"] for r in got if r["doc_id"] == 8).split(",")
    assert spans.where("doc_id = 6 and label = 'gpl' and not base").count() == 1
    assert license_scan.scan(spark, docs_of(spark, []))[1].count() == 0


def brute_spans(words, text, base):
    """(first word, words, cover) of a template's merged spans, hit by hit."""
    t = text.split()
    grams = [tuple(t[k:k + license_scan.GRAM]) for k in range(len(t) - license_scan.GRAM + 1)]
    hits = sorted((p - q, q) for p in range(len(words)) for q, g in enumerate(grams) if tuple(words[p:p + license_scan.GRAM]) == g)
    runs = []
    for d, q in hits:
        if runs and d - runs[-1][-1][0] <= (0 if base else license_scan.GAP):
            runs[-1].append((d, q))
        else:
            runs.append([(d, q)])
    out = []
    for run in runs:
        first, last = min(d + q for d, q in run), max(d + q for d, q in run)
        cover, n = len({q for _, q in run}) / len(grams), last - first + license_scan.GRAM
        if cover == 1 if base else cover >= license_scan.COVER and n <= license_scan.STRETCH * len(t):
            out.append((first, n, round(cover, 9)))
    return out


def test_license_texts_of_any_length_match_brute_force(spark):
    r = random.Random(9)
    mit, bsd = (max((t for label, t in license_scan.NOTICES if label == name), key=len) for name in ("mit", "bsd"))
    rows = []
    for k in range(12):
        w = ("pre " * k + r.choice([mit, bsd]) + " post").split()
        for _ in range(4 * k):
            i = r.randrange(len(w))
            w[i:i + 1] = r.choice([[], ["changed"], [w[i], "more"]])
        rows.append((k, " ".join(w).title()))
    phrases = (("long", " ".join(f"w{k}" for k in range(130))),)
    rows.append((50, "x " + phrases[0][1] + " " + phrases[0][1]))
    spans = license_scan.scan(spark, docs_of(spark, rows), phrases)[0]
    got = sorted((s["doc_id"], s["label"], s["first_word"], s["words"], round(s["cover"], 9)) for s in spans.collect())
    want = sorted((i, label, *x) for i, t in rows for label, text, base in [(*p, True) for p in phrases] + [(*n, False) for n in license_scan.NOTICES]
                  for x in brute_spans(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(ASCII)), text, base))
    assert got == want
    assert {len(t.split()) > 150 for t in (mit, bsd)} == {True} and sum(n > 150 for _, _, _, n, _ in got) >= 6 and [g[2] for g in got if g[1] == "long"] == [1, 131]


def goals(sizes, weights):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    whole, full = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        left = whole - sum(2 * sizes[s] for s in full)
        t = {s: 2 * sizes[s] if s in full else left * w[s] / sum(w[x] for x in free) for s in names}
        over = {s for s in free if t[s] > 2 * sizes[s]}
        if not over:
            return t
        full |= over


def test_mixing(spark):
    r = random.Random(4)
    rows = [(k % 230 if k % 9 else None, prose(r, r.randrange(0, 300)) or None) for k in range(260)] + [(900, prose(r, 15_000)), (901, None), (902, " ")]
    sources = [r.choice(["a", "a", "a", "b", "Z", "é", None, "tiny"] if k % 40 else ["tiny"]) for k in range(len(rows))]
    docs = docs_of(spark, rows, sources)
    got = mixing.mix_counts(spark, docs).toPandas()
    size = lambda t: len((t or "").split())
    sizes = Counter()
    for (_, t), s in zip(rows, sources, strict=True):
        sizes[s] += size(t)
    want = goals(dict(sizes), (3, 1, 2))
    assert sorted(got["size"]) == sorted(size(t) for _, t in rows) and (got.taken <= 2 * got["size"]).all()
    by = got.groupby("source_size").agg(taken=("taken", "sum"), target=("target", "first"))
    for s, t in want.items():
        row = by.loc[sizes[s]]
        assert row.target == pytest.approx(t) and abs(row.taken - t) <= mixing.BLOCK + 1
    again = mixing.mix_counts(spark, docs.repartition(7)).toPandas()
    key = ["size", "source_size", "taken"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))
    docs = docs.withColumns({x: F.lit(7) for x in ("passes", "mark", "twin", "take", "row", "n_chars")})
    mixed = mixing.mix_documents(spark, docs)
    assert mixed.columns == docs.columns and mixed.where("passes = 7 and mark = 7 and twin = 7 and take = 7 and row = 7").count() == mixed.count()
    assert mixed.where("n_chars <> length(text)").count() == 0
    assert sum(size(t["text"]) for t in mixed.select("text").collect()) == got.taken.sum()
    whole = {t for _, t in rows}
    assert sum(t["text"] in whole for t in mixed.select("text").collect()) > 50
    assert mixing.mix_counts(spark, docs_of(spark, [])).count() == 0 and mixing.mix_documents(spark, docs_of(spark, [])).count() == 0


def test_shards_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 16)
    monkeypatch.setattr(mixing, "SHARD", 32)
    r = random.Random(9)
    rows = [(k % 70 if k % 9 else None, prose(r, r.randrange(0, 60)) or None) for k in range(90)] + [(900, prose(r, 1500)), (901, None), (902, " "), (903, "lone"), (903, "lone")]
    sources = [r.choice(["a", "a", "b", "Z", None, ""]) if k < 90 else "b" for k in range(len(rows))]
    docs = docs_of(spark, rows, sources).withColumns({x: F.lit(7) for x in ("words", "parts", "twin", "again", "place", "block", "shard")})
    got = mixing.mix_blocks(spark, docs).toPandas()
    counts = mixing.mix_counts(spark, docs).toPandas()
    assert got.n_words.sum() == counts.taken.sum() and [len(t.split(" ")) for t in got.text] == list(got.n_words) and got.n_words.max() == 16
    assert all(sorted(g.place) == list(range(len(g))) for _, g in got.groupby("shard")) and got.shard.nunique() > 3
    assert not got.duplicated(["source", "block", "pass"]).any()
    names = lambda s: None if s is None or s != s else s
    for source, g in got.groupby(got.source.map(lambda s: repr(names(s)))):
        g = g.drop_duplicates("block").sort_values("block")
        assert (g.n_words[:-1] == 16).all()
        own = [(t or "").split() for (_, t), s in zip(rows, sources, strict=True) if repr(s) == source]
        if len(g) == -(-sum(map(len, own)) // 16):  # every block was drawn: their words in order are the documents, each whole
            said = " " + " ".join(g.text) + " "
            assert Counter(said.split()) == Counter(w for t in own for w in t) and all(" " + " ".join(t) + " " in said for t in own if t)
    inside = got.explode("doc_ids").query("doc_ids == 900")
    assert set(inside.shard) and len(set(inside.shard)) == counts[counts.doc_id == 900].shards.iloc[0]
    again = mixing.mix_blocks(spark, docs.repartition(5)).toPandas()
    key = ["shard", "place", "block", "pass", "n_words", "text"]
    assert sorted(map(tuple, got[key].values)) == sorted(map(tuple, again[key].values))
    assert mixing.mix_blocks(spark, docs_of(spark, [])).count() == 0


def test_permutation(spark):
    for n in (1, 2, 7, 1000):
        s = spark.createDataFrame([("a", 3, n, 2 * n, 5)], "skey string, rank long, n_blocks long, n_slots long, shards long")
        counts = mixing.shard_counts(s, 3)
        assert counts.agg(F.sum("n")).first()[0] == 2 * n
        got = mixing.slots(s, counts, 3).toPandas()
        assert got.groupby("shard").size().to_dict() == {x["shard"]: x["n"] for x in counts.collect()}
        assert sorted(got.block) == sorted(list(range(n)) * 2) and set(got["pass"]) == {0, 1} and got.shard.between(0, 4).all()
        assert n < 1000 or list(got[got["pass"] == 0].block) != list(range(n))


def test_shards_are_multinomial(spark):
    n, k = 60_000, 40
    s = spark.createDataFrame([("a", 1, 50_000, n, k), ("b", 2, 20_000, n // 3, k)], "skey string, rank long, n_blocks long, n_slots long, shards long")
    for skey, total in (("a", n), ("b", n // 3)):
        got = np.array([x["n"] for x in mixing.shard_counts(s, 3).where(f"skey = '{skey}'").collect()])
        assert got.sum() == total and len(got) == k
        chi = ((got - total / k) ** 2 / (total / k)).sum()  # 39 degrees of freedom
        assert 15 < chi < 75


def test_suffix_tree_scores(spark, texts):
    r = random.Random(1)
    rows = [*texts, *[(2000 + k, prose(r, 40)) for k in range(60)], (None, "al be"), (3, "Al\x0bbe x")]
    got = suffix_tree.score(spark, docs_of(spark, rows)).toPandas()
    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(ASCII)), " "]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not out(i) for w in token(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), out(i), len(token(t)), sum(c[w] > 0 for w in token(t)), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in token(t)), 6)) for i, t in rows)
    have = sorted((str(int(g.doc_id)) if g.doc_id == g.doc_id else "None", g.held_out, g.n_tokens, g.n_known, g.train_tokens, round(g.base_score, 6)) for g in got.itertuples())
    assert have == want
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum() and (got.score <= 0).all()
    assert suffix_tree.score(spark, docs_of(spark, [])).count() == 0
    lone = suffix_tree.score(spark, docs_of(spark, [(i, "a b") for i in range(60) if out(i)])).first()
    assert (lone["n_known"], lone["train_tokens"], lone["held_out"]) == (0, 0, True)


def test_suffix_tree_matches_a_tree_of_dictionaries(spark):
    r = random.Random(4)
    rows = []
    for k in range(150):  # three words tell the fourth; other words come at random
        w = []
        for _ in range(r.randrange(16)):
            x = [r.randrange(4) for _ in range(3)]
            w += [f"a{x[0]}", f"b{x[1]}", f"c{x[2]}", f"x{x[0]}{x[1]}{x[2]}", *[f"w{r.randrange(300)}" for _ in range(r.randrange(3))]]
        rows.append((k, " ".join(w)))
    rows += [(300, rows[10][1]), (301, rows[11][1] + " tail"), (302, None), (303, "w1"), (None, rows[12][1])]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    said = {i: [*(t or "").split(), " "] for i, t in rows}
    c = Counter(w for i, t in said.items() if not out(i) for w in t)
    n, once = sum(c.values()), sum(v == 1 for v in c.values())
    unknown = min(max(once, 1) / (n + 1), 0.5)
    root = lambda w: c[w] / n * (1 - unknown) if c[w] else unknown
    seen = defaultdict(Counter)
    for i, t in said.items():
        for k in range(0 if out(i) else len(t)):
            for d in range(1, k + 1):
                seen[tuple(t[k - d:k])][t[k]] += 1
    total = {x: sum(y.values()) for x, y in seen.items()}
    states = {}

    def p(context, w):
        """Probability by the longest state that the context ends with."""
        own = root(w)
        for d in range(1, len(context) + 1):
            x = context[-d:]
            if x not in states:
                break
            own = (seen[x][w] + suffix_tree.WEIGHT * own) / (total[x] + suffix_tree.WEIGHT)
        return own

    for x in sorted(seen, key=len):
        if total[x] >= 2 and (len(x) == 1 or x[1:] in states):
            if sum(m * np.log(m / total[x] / p(x[1:], w)) - np.log(len(c)) for w, m in seen[x].items()) >= 0:
                states[x] = True
    assert max(map(len, states)) > 2
    for x in random.Random(5).sample(sorted(states), 30):
        assert sum(p(x, w) for w in [*c, "unknown"]) == pytest.approx(1)
    got = {g["doc_id"]: g["score"] for g in suffix_tree.score(spark, docs_of(spark, rows)).collect()}
    for i, t in said.items():
        assert got[i] == pytest.approx(sum(np.log10(p(tuple(t[:k]), t[k])) for k in range(len(t))))
    # Texts that occur twice stand out.
    assert got[300] > 2 * sum(np.log10(root(w)) for w in said[300]) / 3


def test_suffix_tree_in_parts(spark, monkeypatch):
    """Rounds that take slabs by parts and pairs by ranges of keys give whole rounds' scores, and hardly keep a slab twice."""
    r = random.Random(8)
    rows = [(k, prose(r, 50)) for k in range(150)]
    rows += [(300 + k, rows[k][1]) for k in range(40)]
    docs = docs_of(spark, rows).repartition(12)
    kept, tables = [], []

    class Watched(suffix_tree.Scratch):
        def keep(self, df, name, by=None):
            out = super().keep(df, name, by)
            tables.append(name)
            kept.append(sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{self.root}/*-slabs/**/*.parquet", recursive=True)))
            return out

    monkeypatch.setattr(suffix_tree, "Scratch", Watched)
    scores = lambda: sorted(tuple(x) for x in suffix_tree.score(spark, docs).collect())
    whole, n = scores(), kept[0]
    assert n >= 8 and max(kept) == 2 * n
    monkeypatch.setattr(suffix_tree, "MANY", 0)
    kept.clear(), tables.clear()
    assert scores() == whole
    assert kept[0] == n and max(kept) <= n + -(-n // suffix_tree.PARTS) + 1
    assert tables[:8] == ["slabs", "answers"] + ["slabs"] * 6 and tables[8:10] == ["answers"] * suffix_tree.RANGES


def test_sums_of_slabs():
    """A round's keys come back in order with the sums of all slabs, whatever their buckets."""
    r, model = random.Random(3), (48,)
    states = []
    for _ in range(4):
        words, stream = np.unique(np.array([r.randrange(40) * 0x9E3779B97F4A7C15 % (1 << 64) for _ in range(300)], np.uint64), return_inverse=True)
        states.append(suffix_tree.pack({"train": np.array([True, False]), "size": np.array([200, 100]), "words": words, "stream": stream.astype(np.uint32)}))
    batch = pa.RecordBatch.from_arrays([pa.array(range(4), pa.int64()), pa.array(states, pa.binary())], names=["slab", "state"])
    asked = pa.Table.from_batches(suffix_tree._asked(model, 7)([batch]))
    slabs = [suffix_tree.Slab(x, model).ask() for x in states]
    want, back = Counter(), defaultdict(list)
    for keys, values, _ in slabs:
        for x, y in zip(keys.tolist(), values.tolist(), strict=True):
            want[x] += y
    assert sum(want.values()) == 800
    for b in range(7):
        answer = suffix_tree._sum_up(asked.filter(pa.compute.equal(asked.column("bucket"), b)))
        for slab, sums in zip(answer.column("slab").to_pylist(), answer.column("sums").to_pylist(), strict=True):
            back[slab] += suffix_tree.unpack(sums)["v"].tolist()
    for j, (keys, _, _) in enumerate(slabs):
        assert back[j] == [want[x] for x in keys.tolist()]


def test_toxicity(spark):
    r = random.Random(9)
    rows, labels = [], []
    for k in range(600):
        words = prose(r, r.randrange(5, 60)).split()
        bad = k % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["blorgface", "zorkel", "grumpf" + prose(r, 1)]))
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    rows += [(700, None), (701, ""), (None, "zorkel blorgface"), (702, prose(r, 20_000)), (3, rows[3][1])]
    docs = docs_of(spark, rows)
    made = spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = toxicity.score(spark, docs, made).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out & (got.doc_id < 600)]
    assert (held.held_out == [zlib.crc32(str(int(i)).encode()) % 4 == 2 for i in held.doc_id]).all()
    assert ((held.doc_id % 5 == 0) == (held.predicted == 1)).mean() > 0.97
    assert got[got.doc_id.isin([700, 701])].predicted.sum() == 0
    # Labels of held-out rows and other columns change nothing.
    clash = docs.withColumns({x: F.lit(7) for x in ("c0", "_text", "score", "predicted", "x")})
    assert toxicity.score(spark, clash, made).where("c0 = 7 and _text = 7 and x = 7 and score between 0 and 1").count() == len(rows)
    other = toxicity.score(spark, docs.withColumn("source", docs.source), spark.createDataFrame([(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 != 2], "doc_id long, toxic int")).toPandas()
    assert np.allclose(sorted(got.score), sorted(other.score))
    none = toxicity.score(spark, docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.count() == len(rows) and toxicity.score(spark, docs_of(spark, []), made).count() == 0


def test_grammar():
    follow, written, out = toxicity.grammar()

    def read(classes):
        state, got = 0, ""
        for c in classes:
            k = toxicity.CLASSES.index(c)
            got += out[written[state][k]]
            state = follow[state][k]
        return got

    assert read("OIO") == "OIO" and read("YOI") == "YOU" and read("NI") == "Nn" and read("NOOOI")[-1] == "I"
    assert read("ROI") == "ROq" and read("RNI")[-1] == "q" and read("TOY") == "TOH" and read("YT") == "YT"

    r = random.Random(12)
    rules = toxicity.machines()
    for _ in range(300):
        said = [r.choice(toxicity.CLASSES) for _ in range(r.randrange(30))]
        now = said
        for machine in rules:
            state, wrote = 0, []
            for c in now:
                state, w = machine[state, c]
                wrote.append(w)
            now = wrote
        assert read(said) == "".join(now)
