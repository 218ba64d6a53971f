"""The multi-index, the prefix trie and the ranked search against brute force, and on odd rows."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import neighbours, prefix_trie, queries, ranked_search

DATA = "/root/testdata/sf0.001"


# ---- multi-index ----------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=9), st.lists(st.integers(-5, 5), min_size=1, max_size=9))
def test_walk_gives_every_pair_once_in_order(a, b):
    got = list(neighbours.walk(np.array(a, float), np.array(b, float)))
    assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(len(a)) for j in range(len(b))]
    assert [s for s, _, _ in got] == sorted((x + y for x in a for y in b), reverse=True)


def brute_neighbours(rows, k=20, nth=20):
    """query row -> [(vec_id, score)] over rows (vec_id, vector) that take part."""
    some = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    common = Counter(len(v) for _, v in some)
    dim = min(common, key=lambda d: (-common[d], d)) if common else 0
    some = [(i, v) for i, v in some if len(v) == dim]
    m = np.array([v for _, v in some])
    out = []
    for at, (i, v) in enumerate(some):
        if i % nth == 0:
            s = (m * v).sum(axis=1)
            out.append((i, sorted(((-x + 0.0, j) for n, (x, (j, _)) in enumerate(zip(s, some, strict=True)) if n != at))[:k]))
    return out


def test_neighbours_of_odd_and_repeated_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).round(3).tolist()) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 0.0, -1.0, 0.5]) for i in range(70)] + [(40, rows[7][1]), (100, [1.0, 2.0, 3.0, 0.0, -1.0, 0.5])]
    rows += [(200, None), (220, [0.0] * 6), (240, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (260, [float("nan")] * 6), (280, [1.0, 2.0]), (300, []), (320, [float("inf")] + [1.0] * 5), (None, [1.0] * 6)]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows], "vec_id long, embedding array<double>, uid int, rank string")
    got = defaultdict(list)
    for r in neighbours.neighbours(df).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    want = defaultdict(list)
    for i, near in brute_neighbours(rows):
        want[i] += [(n + 1, j, -s) for n, (s, j) in enumerate(near)]
    assert set(got) == set(want)
    for i, near in want.items():  # fewer rows than the first leg visits: exact
        assert sorted((n, j) for n, j, _ in got[i]) == sorted((n, j) for n, j, _ in near)
        assert np.allclose(sorted(s for *_, s in got[i]), sorted(s for *_, s in near), rtol=0, atol=1e-12)
    assert neighbours.neighbours(df.where("vec_id < 0")).count() == 0
    few = {(r.query_id, r["rank"], r.vec_id) for r in neighbours.neighbours(df.where("vec_id in (0, 1, 2, 200)")).collect()}
    assert {(q, n) for q, n, _ in few} == {(0, 1), (0, 2)}


def test_recall_of_neighbours(spark):
    """Against brute force on vectors without structure, the hardest kind, and scores as they are."""
    t = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    m, ids = np.array(t["embedding"].tolist(), float), t["vec_id"].to_numpy()
    got = queries.QUERIES["op11_multi_index"](spark, "/root/testdata/sf0.1").toPandas()
    assert set(got["query_id"]) == set(ids[ids % 20 == 0])
    place, hit = {i: n for n, i in enumerate(ids)}, 0
    for q, own in got.groupby("query_id"):
        own = own.sort_values("rank")
        s = m @ m[place[q]]
        s[place[q]] = -np.inf
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(own["vec_id"]))
        assert list(own["rank"]) == list(range(1, 21)) and np.allclose(s[[place[i] for i in own["vec_id"]]], own["score"], rtol=0, atol=1e-12)
        assert (np.diff(own["score"]) <= 0).all()
    assert hit >= 0.9 * len(got)


# ---- prefix trie ----------------------------------------------------------------------------------------------------


def brute_trie(rows):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    seqs = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seqs[c] = own.get(c - c % 5, [])[:h] + seq[h:]
    members = defaultdict(list)
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[q] for q in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if len(seqs[c]) == len(p)))).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], digest(p)) for p, m in members.items())


def test_trie_against_brute_force(spark):
    rng, rows = random.Random(4), []
    for c in range(90):
        for t in range(rng.choice([0, 1, 2, 3, 5, 8, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "ü", "a b"])))
    rows += [(200 + c, t, "user", f"same {t}") for c in range(40) for t in range(11)]  # copies; a long one; ties and far turn numbers
    rows += [(300, t * 700, "user", "x" * (t % 4)) for t in range(40)] + [(310, None, "b", "z"), (310, 5, "b", "z"), (310, 5, "a", "z"), (310, 5, "b", "z"), (None, 1, "user", "lost")]
    rows += [(301, t * 700, "user", "x" * (t % 4)) for t in range(33)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "conv_id long, turn long, role string, text string, depth int, name string")
    got = sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in prefix_trie.trie(df).collect())
    assert got == brute_trie(rows)
    assert prefix_trie.trie(df.where("conv_id < 0")).count() == 0


def tables(*names, d=DATA):
    con = duckdb.connect()
    for t in names:
        path = f"{d}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/**/*.parquet' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize(("name", "names"), [("op12_prefix_trie", ["conversations"]), ("op13_ranked_search", ["documents", "benchmark"])])
def test_query_is_its_sql(spark, name, names):
    got = queries.QUERIES[name](spark, DATA)
    con = tables(*names)
    assert sorted(got.columns) == sorted(c[0] for c in con.execute(f"describe {queries.ORACLES[name]}").fetchall())
    want = con.execute(f"select {', '.join(got.columns)} from ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


# ---- ranked search --------------------------------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_ranks(docs, items):
    found = [(d, Counter(terms(t))) for d, t in docs]
    found = [(d, c, sum(c.values())) for d, c in found if c]
    n_docs, length = len(found), sum(n for *_, n in found)
    df = Counter(t for _, c, _ in found for t in c)
    out = []
    for item, text in items:
        asked, scores = set(terms(text)) & set(df), []
        for d, c, n in found:
            m = 100 - 90 + (90 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in asked if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0))
        out += [(item, rank + 1, None if none else d, -s) for rank, (s, none, d) in enumerate(sorted(scores)[:10])]
    return out


def test_ranks_against_brute_force(spark):
    rng = random.Random(8)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 900}"
    docs = [(i, " ".join(word() for _ in range(rng.randrange(1, 60)))) for i in range(700)]
    docs += [(2_000 - i, "w1 w2 Common-Passage w17 w33") for i in range(300)] + [(1_500, docs[3][1]), (None, docs[3][1]), (None, None), (3_000, ""), (3_001, " .,- "), (3_002, "ÄÖ straße W17")]
    docs += [(3_003, " ".join(word() for _ in range(60_000)))]
    items = [(i, " ".join(word() for _ in range(rng.randrange(1, 30)))) for i in range(25)] + [(25, "common passage w17"), (26, None), (27, "?!"), (28, "neverseen"), (25, "w1"), (29, docs[3][1]), (30, "STRASSE straße ÄÖ äö")]
    df = spark.createDataFrame([(d, t, 1, 2, "k") for d, t in docs], "doc_id long, text string, n int, score int, key string")
    asked = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, rank int")
    got = [tuple(r) for r in ranked_search.search(df, asked).collect()]
    assert sorted(map(str, got)) == sorted(map(str, brute_ranks(docs, items)))
    assert ranked_search.search(df.where("doc_id < 0"), asked).count() == 0 and ranked_search.search(df, asked.where("item_id < 0")).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_pruned_search_of_a_tree_loses_nothing(monkeypatch, seed):
    monkeypatch.setattr(ranked_search, "LEAF", 4)
    rng = np.random.default_rng(seed)
    width, n = 40, 300
    ids = [np.sort(rng.choice(width, rng.integers(1, 12), replace=False)).astype(np.int32) for _ in range(n)]
    x = [rng.integers(1, 10 ** rng.integers(1, 11), len(i)) for i in ids]
    m = ranked_search.Sparse(np.concatenate([[0], np.cumsum([len(i) for i in ids])]), np.concatenate(ids), np.concatenate(x))
    order, nodes, radii, c_ptr, c_ids, c = ranked_search.ball_tree(m, width)
    a = ranked_search.Asked([(k, [b"%02d" % t for t in rng.choice(width, 6, replace=False)]) for k in range(8)] + [(8, [b"%02d" % t for t in range(width)])])
    bounds, own, mask = a.bounds(radii, c_ptr, c_ids, c), m.take(order), np.zeros(width, np.int64)
    every = [a.scores(mask, k, own.ptr, own.ids, own.x) for k in range(9)]
    for node, (start, end, *_) in enumerate(nodes):
        assert all(every[k][start:end].max() <= bounds[node, k] for k in range(9))
    leaf = lambda item, s, e: every[item][s:e]
    for k in range(9):
        want = sorted((-int(s), (False, int(order[i]))) for i, s in enumerate(every[k]) if s > 0)[:10]
        for floor in (0, -want[-1][0]):
            assert ranked_search.best_first(a, k, bounds, nodes, leaf, lambda i: [(False, int(order[i]))], floor, 10) == want
