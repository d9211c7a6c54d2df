"""Vector operators and chat formatting against brute force."""

import hashlib
import random

import numpy as np
import pytest

from tidewright.llm import candidates, components, lattice, prefix_forest, reply_trees
from tidewright.llm.common import Scratch

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, id long, key long, tree int"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, 1, 2, 3) for i, v, y in rows], SCHEMA)


def unit(rng, n, dim=64):
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near(rng, v, cos):
    w = rng.normal(size=len(v))
    w -= w @ v * v
    return cos * v + np.sqrt(1 - cos * cos) * w / np.linalg.norm(w)


def table(rng):
    rows = []
    for k, v in enumerate(unit(rng, 150)):
        rows.append((10 * k, v, k % 3))
        for j in range(1, rng.integers(1, 4)):
            rows.append((10 * k + j, near(rng, v, rng.choice([0.985, 0.99, 0.97, 0.93])) * rng.choice([1, 7.5]), k % 3))
    rows += [(9001, rows[0][1], rows[0][2]), (9002, rows[0][1], 2 - rows[0][2]), (9003, rows[0][1], None), (9004, None, 0), (9005, [0.0] * 64, 0),
             (9006, [NAN] + [1.0] * 63, 0), (9007, [INF] + [1.0] * 63, 0), (9008, [None] + [1.0] * 63, 0), (9009, [], 0), (9010, [1.0, 2.0], 0), (9011, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    return rows + [rows[5]]


def valid(v):
    return v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def test_near_duplicate_vectors(spark):
    rows = table(np.random.default_rng(11))
    got = lattice.near_duplicates(spark, vectors(spark, rows)).collect()
    ids = sorted({i for i, _, _ in rows if i is not None})
    assert sorted(r["vec_id"] for r in got if r["vec_id"] is not None) == ids
    as_float = {i: (np.asarray(v, np.float32).astype(float), y) for i, v, y in rows if i is not None and valid(v) and y is not None}
    up, n = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(as_float)
    for a in keys:
        for b in keys:
            (u, y), (v, z) = as_float[a], as_float[b]
            if a < b and y == z and len(u) == len(v) and u @ v / np.linalg.norm(u) / np.linalg.norm(v) >= 0.98:
                n[a], n[b] = n[a] + 1, n[b] + 1
                x, w = find(a), find(b)
                up[max(x, w)] = min(x, w)
    have = {r["vec_id"]: r for r in got}
    assert sum(n.values()) > 50
    assert {i: have[i]["n_links"] for i in ids} == n and {i: have[i]["component_id"] for i in ids} == {i: find(i) for i in ids}
    assert all(have[i]["kept"] == (find(i) == i) for i in ids) and have[None]["component_id"] is None
    assert lattice.near_duplicates(spark, vectors(spark, [])).count() == 0


def test_a_large_cell_is_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(lattice, "CHUNK", 64)
    rng = np.random.default_rng(12)
    v = unit(rng, 1)[0]
    got = lattice.near_duplicates(spark, vectors(spark, [(k, near(rng, v, 0.999), 1) for k in range(400)])).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(399, 0)}


def test_e8():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8)) * 2
    p = lattice.decode(x)
    assert len(lattice.minimal_vectors()) == 240
    assert np.allclose((2 * p) % 1, 0) and np.allclose(p.sum(axis=1) % 2, 0) and (((p % 1) == 0).all(axis=1) | ((p % 1) == 0.5).all(axis=1)).all()
    others = p[:, None, :] + np.concatenate([lattice.minimal_vectors(), 2 * np.eye(8), -2 * np.eye(8)])[None]
    assert (((x - p) ** 2).sum(axis=1) <= ((x[:, None, :] - others) ** 2).sum(axis=2).min(axis=1) + 1e-9).all()


def test_lattice_recall():
    rng = np.random.default_rng(2)
    u = unit(rng, 3000)
    v = np.stack([near(rng, x, 0.98) for x in u])
    (a, pa), (b, pb) = lattice.cells(u, 0), lattice.cells(v, 0)
    k = lattice.BLOCKS * lattice.PROBES
    hit = (a == b).any(axis=1)
    for t in range(lattice.TABLES):
        for j in range(k):
            hit |= (a[:, t] == pb[:, t * k + j]) | (b[:, t] == pa[:, t * k + j])
    assert hit.mean() > 0.999


def test_nearest_vectors(spark):
    rng = np.random.default_rng(13)
    rows = table(rng)
    rows += [(20000 + k, rows[0][1], 0) for k in range(40)]
    data = vectors(spark, rows)
    got = prefix_forest.nearest(spark, data, data.where("vec_id % 20 = 0"), 20).toPandas()
    have = {i: np.asarray(v, np.float32).astype(float) for i, v, _ in rows if i is not None and valid(v)}
    hits = want = 0
    for q, u in have.items():
        if q % 20:
            continue
        scores = sorted(((-(u @ v), i) for i, v in have.items() if i != q and len(v) == len(u)))[:20]
        g = got[got.query_id == q].sort_values("rank")
        assert list(g["rank"]) == list(range(1, len(scores) + 1)) and q not in set(g.vec_id)
        assert np.allclose(g.score, [u @ have[i] for i in g.vec_id]) and (np.diff(g.score) <= 1e-12).all()
        ties = g.groupby(g.score).vec_id.apply(list)
        assert all(x == sorted(x) for x in ties)
        hits += sum(s >= -scores[-1][0] - 1e-9 for s in g.score)
        want += len(scores)
    assert hits / want >= 0.9 and len(got) == want
    few = vectors(spark, rows[:3])
    assert prefix_forest.nearest(spark, few, few, 20).count() == 6
    assert prefix_forest.nearest(spark, vectors(spark, []), vectors(spark, [])).count() == 0


def test_components(spark):
    r = random.Random(5)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, r.randrange(501, 900)) for _ in range(300)] + [(r.randrange(1000, 1300), r.randrange(1000, 1300)) for _ in range(150)]
    got = {x["id"]: x["component_id"] for x in components.connected_components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t")).collect()}
    up = {i: i for p in links for i in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    loops = {a for a, b in links if a == b and sum(a in p for p in links) == 1}
    assert got == {i: find(i) for i in up if i not in loops}


def test_blocks_meet_every_pair_once(spark):
    df = spark.createDataFrame([(1, k) for k in range(30)] + [(2, 5)], "key long, id long")
    x = lattice.blocks(df, "key", 8).collect()
    met = {}
    for r in x:
        met.setdefault((r["key"], r["i"], r["j"]), []).append((r["id"], r["own"]))
    pairs = [tuple(sorted((a, b))) for (_, i, j), m in met.items() for a, p in m for b, q in m if a < b and (i == j or p != q)]
    assert sorted(pairs) == [(a, b) for a in range(30) for b in range(a + 1, 30)]


def test_links_across_connect_what_links_connect(spark, monkeypatch):
    monkeypatch.setattr(candidates, "CHUNK", 8)
    r = random.Random(6)
    # key 1: a large component, one that is near it, and single ids; key 2: a part of it; key 3: connected.
    comp = {k: 0 if k < 40 else 40 if k < 50 else k for k in range(70)}
    held = {k: [1, 2] if k % 3 == 0 else [1, 3] if k < 40 else [1] for k in comp}
    value = {k: r.randrange(30) for k in comp}
    df = spark.createDataFrame([(key, k, comp[k]) for k in comp for key in held[k]], "key long, id long, component_id long")
    table = spark.createDataFrame([(k, held[k], [value[k] >> 2], bytes([value[k]])) for k in comp], "id long, held array<long>, sketch array<long>, payload binary")
    got = candidates.links_across(df, table, 1, 1, lambda a, b: abs(a[0] - b[0]) <= 1, Scratch(spark, "t"), 4).collect()
    want = [(a, b) for a in comp for b in comp if b < a and comp[a] != comp[b] and abs(value[a] - value[b]) <= 1 and ((value[a] >> 2) ^ (value[b] >> 2)).bit_count() <= 1]
    assert {(x["a"], x["b"]) for x in got} <= set(want)

    def joined(pairs):
        up = dict.fromkeys(comp)
        for k in comp:
            up[k] = comp[k]
        for a, b in pairs:
            one, two = up[a], up[b]
            up = {k: min(one, two) if v in (one, two) else v for k, v in up.items()}
        return up

    assert joined((x["a"], x["b"]) for x in got) == joined(want)


CHAT = "conv_id long, turn long, role string, text string, node long, tree string"


def test_formatting_reads_back(spark):
    odd = [reply_trees.SAMPLE, "<\\|im_end|>", "<", "|", "<|", "<\\\\|x", None, "", "é\n<|im_start|>user\n", "y" * 50_000]
    rows = [(k, t, ["user", "assistant", "sys\n<|tem\\n", None][(k + t) % 4], odd[(k * 3 + t) % len(odd)], 0, "x") for k in range(8) for t in range(k + 1)]
    rows += [(None, 1, "user", "a", 0, "x"), (None, 0, "assistant", "b", 0, "x"), (50, None, "user", "n", 0, "x"), (50, 3, "assistant", "m", 0, "x"), (50, 3, "assistant", "m", 0, "x")]
    formatted = reply_trees.format_trees(spark, reply_trees.chains(spark.createDataFrame(rows, CHAT)))
    got = {r["conv_id"]: r for r in reply_trees.digest(formatted).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lows = lambda v: (v is not None, v if v is not None else 0)
    for c in {r[0] for r in rows}:
        turns = sorted((r[1:4] for r in rows if r[0] == c), key=lambda t: (lows(t[0]), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or "")))
        said = "".join(x or "" for _, role, x in turns if role == "assistant")
        assert got[c]["n_turns"] == len(turns) and got[c]["turns_sha256"] == sha("".join(f"{r or ''}\n{x or ''}\n" for _, r, x in turns))
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), sha(said))
    assert reply_trees.format_trees(spark, reply_trees.chains(spark.createDataFrame([], CHAT))).count() == 0


def test_trees_and_ranks(spark):
    #      1 - 2 - 3          scores of paths: 1-2-3: 3, 1-2-4: 4, 1-5: 1.5
    nodes = [("t", 1, None, "user", "q", 3.0), ("t", 2, 1, "assistant", "a", 3.0), ("t", 3, 2, "user", "b", 3.0), ("t", 4, 2, "user", "c", 6.0), ("t", 5, 1, "assistant", "d", 0.0),
             ("u", 1, 77, "user", "lost parent", 1.0), ("v", 1, 2, "user", "x", 1.0), ("v", 2, 1, "user", "y", 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, role string, text string, score double")
    read = lambda best: sorted((r["tree"], [t for _, t in reply_trees.read_back(r["formatted"])]) for r in reply_trees.format_trees(spark, df, best).collect())
    assert read(None) == [("t", ["q", "a", "b"]), ("t", ["q", "a", "c"]), ("t", ["q", "d"]), ("u", ["lost parent"])]
    assert read(1) == [("t", ["q", "a", "c"]), ("u", ["lost parent"])]
    chain = spark.createDataFrame([("w", k, k - 1 if k else None, "user", str(k), 0.0) for k in range(41)], df.schema)
    row = reply_trees.format_trees(spark, chain).first()
    assert [t for _, t in reply_trees.read_back(row["formatted"])] == [str(k) for k in range(41)] and row["loss"] == []


@pytest.mark.parametrize("backwards", [False, True])
def test_rows_that_share_a_vec_id_keep_the_links_of_each(spark, backwards):
    r = np.random.default_rng(5)
    rows, near = [], []
    for k in range(20):
        for side in range(2):
            v = r.normal(size=16)
            rows.append((k, v.tolist(), 1))
            rows.append((100 + 2 * k + side, (v + 0.001 * r.normal(size=16)).tolist(), 1))
            near.append(100 + 2 * k + side)
    df = spark.createDataFrame(rows[::-1] if backwards else rows, "vec_id long, embedding array<double>, label int").coalesce(1)
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in lattice.near_duplicates(spark, df).collect()}
    assert {i: got[i] for i in near} == {i: (1, (i - 100) // 2) for i in near}
    assert {k: got[k] for k in range(20)} == {k: (2, k) for k in range(20)}


def test_shared_lengths():
    rng = np.random.default_rng(5)
    code = np.sort(np.concatenate([rng.integers(0, 1 << prefix_forest.BITS, 300), np.repeat(rng.integers(0, 1 << prefix_forest.BITS, 4), 9)]))
    asks = np.concatenate([rng.integers(0, 1 << prefix_forest.BITS, 50), code[::7]])
    for n in (1, 5, 21):
        level, edge = prefix_forest.shared_lengths(code, asks, n)
        want = [sorted((prefix_forest.BITS - int(a ^ c).bit_length() for c in code.tolist()), reverse=True)[n - 1] for a in asks.tolist()]
        assert (level <= want).all() and (level[~edge] == np.array(want)[~edge]).all() and not edge.all()
    level, edge = prefix_forest.shared_lengths(code[:0], asks, 3)
    assert not level.any() and edge.all()


def test_descents_do_not_depend_on_ranges(spark):
    rng = np.random.default_rng(8)
    u = unit(rng, 400, 16) * rng.uniform(0.5, 2, (400, 1))
    u[50:90] = u[50]  # equal strings: a range may end among them
    top = float(np.linalg.norm(u, axis=1).max()) * (1 + 1e-9)
    rows = spark.createDataFrame([(k, 16, v.tolist()) for k, v in enumerate(u)], "id long, dim int, v array<double>")
    asks = rows.where("id % 3 = 0")
    got = {r["id"]: r["level"] for r in prefix_forest._descend(rows, asks, {16: top}, 5, 0, 40, Scratch(spark, "t")).collect()}
    x = u / top
    code = prefix_forest.strings(np.column_stack([x, np.sqrt(np.maximum(1 - (x * x).sum(axis=1), 0))]), 0)
    ask = prefix_forest.strings(np.column_stack([u / np.linalg.norm(u, axis=1, keepdims=True), np.zeros(400)]), 0)
    held = {q: [sorted((prefix_forest.BITS - int(a ^ c).bit_length() for c in code[:, t].tolist()), reverse=True)[4] for t, a in enumerate(ask[q].tolist())] for q in range(0, 400, 3)}
    assert got == {q: sorted(x, reverse=True)[prefix_forest.TREES // 2 - 1] for q, x in held.items()}


@pytest.mark.parametrize("noise, share", [((0.1, 0.2), 0.1), ((0.2, 0.5), 0.4)])
def test_recall_and_rows_seen(spark, noise, share):
    """The nearer a query's neighbours are, the fewer rows it is compared with, counted in every tree."""
    rng = np.random.default_rng(21)
    n, dim = 20_000, 32
    centres = unit(rng, n // 40, dim)
    w = unit(rng, n, dim)
    u = np.repeat(centres, 40, axis=0)
    u = (u + rng.uniform(*noise, (n, 1)) * w) * rng.uniform(0.9, 1, (n, 1))
    u = u.astype(np.float32)
    data = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(u)], "vec_id long, embedding array<float>")
    got = prefix_forest.nearest(spark, data, data.where("vec_id % 100 = 0"), 20).toPandas()
    scores = u[::100].astype(float) @ u.astype(float).T
    scores[np.arange(200), np.arange(0, n, 100)] = -np.inf
    last = np.sort(scores, axis=1)[:, -20]
    hits = sum((g.score >= last[q // 100] - 1e-9).sum() for q, g in got.groupby("query_id"))
    assert len(got) == 4000 and hits / 4000 >= 0.9
    seen = got.groupby("query_id").seen.first()
    assert len(seen) == 200 and seen.sum() < 200 * n * share
