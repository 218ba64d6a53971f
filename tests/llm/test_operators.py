"""The training-data operators against brute force, and on odd rows."""

import base64
import hashlib
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle

import corpus_pipeline
from docweave.llm import bpe, chat, decontaminate, license_scan, line_dedup, ngram_join, quality, suffix_dedup, token_counts, toxicity
from docweave.llm.components import components

try:
    import public_tokenizers as P
except ImportError:
    P = None  # only the tests of the tokenizer's file need it
SCHEMA = "doc_id long, text string, n_words int, key string, uid long"


def frame(spark, texts, first=1):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(first + i, t, -1, "k", 7) for i, t in enumerate(texts)], SCHEMA)


def words(n, rng, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(words(4000, random.Random(5)))
    return frame(spark, [None, "", "  \n\t ", "one", "one", "Grüße aus Köln 🎉", long, long, "a b", "\x00 \x85x"])


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, ["x"]).where("doc_id < 0")


# ---- byte-level BPE -------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def ranks():
    if P is None:
        pytest.skip("no tokenizer files")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}


@pytest.fixture(scope="module")
def library(ranks):
    return pytest.importorskip("tiktoken").Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(df, ranks, **sizes):
    return {(r.doc_id, i): r for i, r in enumerate(bpe.digests(bpe.decode(bpe.encode(df, ranks, P.PATTERN, **sizes), ranks)).orderBy("doc_id").collect())}


@pytest.mark.parametrize("sizes", [{}, {"chunk": 50, "overlap": 20}, {"chunk": 8, "overlap": 2}])
def test_bpe_is_exact(spark, ranks, library, sizes):
    rng = random.Random(1)
    texts = ["it's   the\n\n  end  ", "x" * 300, " " * 200 + "a", "don't 123456 !!??", None, "", "naïve ça 日本語テキスト 🎉🎉", "a  b\t\tc" * 40, "".join(rng.choice("ab 'st\n1!é ") for _ in range(2000)), "<|endoftext|> x"]
    got = [r for _, r in sorted(encoded(frame(spark, texts), ranks, **sizes).items())]
    for t, r in zip(texts, got, strict=True):
        ids = library.encode_ordinary(t or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()), t


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=60))
def test_merge_is_the_librarys(ranks, library, text):
    pieces = library._pat_str and __import__("regex").findall(P.PATTERN, text)
    assert [i for p in pieces for i in bpe.merge(p.encode("utf-8", "replace"), ranks)] == library.encode_ordinary(text)


def test_bpe_of_odd_rows(odd, empty, ranks):
    assert len(encoded(odd, ranks)) == odd.count() and not encoded(empty, ranks)


# ---- n-gram join ----------------------------------------------------------------------------------------------------


def sets_of(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) > 2 else frozenset([tuple(w)] if w else [])


def joined(texts, first=1):
    sets = [sets_of(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 90 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [(first + i, len(s), first + find(i)) for i, s in enumerate(sets)]


def near_copies(rng):
    texts = [" ".join(words(n, rng)) for n in (3, 9, 12, 30, 31, 60, 120, 250)]
    for base in list(texts):
        for _ in range(12):
            w = base.split()
            for _ in range(rng.randrange(4)):
                i = rng.randrange(len(w))
                w[i : i + rng.randrange(2)] = [f"n{rng.randrange(10**6)}"]
            texts.append(" ".join(w))
    rng.shuffle(texts)
    return texts + texts[:10] + [None, "", "A B c", "a b C", "one", "ONE", "a b"]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_are_exact(spark, seed):
    texts = near_copies(random.Random(seed))
    got = sorted(tuple(r)[:3] for r in ngram_join.duplicates(frame(spark, texts)).collect())
    assert got == joined(texts)


@pytest.mark.parametrize("boundary,few,each", [(200, 4, 16), (8, 2, 0), (60, 2, 1)])
def test_light_subsets_and_long_lists(spark, monkeypatch, boundary, few, each):
    """The same classes when nearly all sets are light, when all are heavy, and when lists of three go by pivots."""
    texts = near_copies(random.Random(3))
    monkeypatch.setattr(ngram_join, "boundary_of", lambda nodes: boundary)
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "EACH", each)
    assert sorted(tuple(r)[:3] for r in ngram_join.duplicates(frame(spark, texts)).collect()) == joined(texts)


@pytest.mark.parametrize("shape", ["changed", "shortened", "chain"])
def test_large_groups_of_near_copies(spark, monkeypatch, shape):
    """Groups of which many do not link with each other: copies with 0 to 9 changes, cut copies, and a chain."""
    rng = random.Random(14)
    monkeypatch.setattr(ngram_join, "boundary_of", lambda nodes: 9)
    monkeypatch.setattr(ngram_join, "EACH", 1)
    base = words(150, rng, 10**6)
    texts = []
    for i in range(60):
        w = list(base)
        if shape == "changed":
            for _ in range(rng.randrange(10)):
                w[rng.randrange(len(w))] = f"n{rng.randrange(300)}"
        elif shape == "shortened":
            w = w[rng.randrange(12) : 150 - rng.randrange(40)]
        else:
            w[: 2 * i] = [f"n{j}" for j in range(2 * i)]
        texts.append(" ".join(w))
    assert sorted(tuple(r)[:3] for r in ngram_join.duplicates(frame(spark, texts)).collect()) == joined(texts)


@pytest.mark.parametrize("sent", [0, 32 << 20])
def test_pairs_are_verified_alike_in_blocks(spark, monkeypatch, sent):
    """Many pairs, sent to the sets or shuffled, are decided as all pairs are by brute force."""
    rng = np.random.default_rng(5)
    sets = {i: np.sort(rng.choice(40, int(rng.integers(20, 38)), replace=False)).astype(np.uint64) for i in range(30)}
    pairs = [(a, b) for a in range(30) for b in range(a + 1, 30) if a < 3 or (a + b) % 3 == 0]
    want = {(a, b) for a, b in pairs if 100 * len(set(sets[a].tolist()) & set(sets[b].tolist())) >= 70 * len(set(sets[a].tolist()) | set(sets[b].tolist()))}
    monkeypatch.setattr(ngram_join, "TOGETHER", 0)
    monkeypatch.setattr(ngram_join, "SENT", sent)
    frames = spark.createDataFrame(pairs, "a long, b long"), spark.createDataFrame([(i, g.tobytes()) for i, g in sets.items()], "node long, grams binary")
    got = [tuple(r) for r in ngram_join.verified(*frames, 70).select("a", "b").collect()]
    assert want and set(got) == want and len(got) == len(want)


def test_word_hashes_of_pieces(spark):
    """Words are equal when their hashes are, also across pieces, beside long words and runs of blanks."""
    from docweave.llm.common import PIECE, lower_word_hashes

    texts = [b"", b"  ", b"A b\ta\r\nB", b"y " * PIECE, b"a " + b"q" * (2 * PIECE) + b" A", b" " * (2 * PIECE) + b"b", b"q" * PIECE, b"z" * 70 + b" a " + b"z" * 71]
    seen = {}
    for text in texts:
        words, found = text.lower().split(), lower_word_hashes(text).tolist()
        assert len(words) == len(found) and all(seen.setdefault(w, h) == h for w, h in zip(words, found, strict=True))
    assert len(set(seen.values())) == len(seen)


def test_rounds_do_not_grow_with_a_group(spark, monkeypatch):
    """Copies of one text with 1 to 3 words changed, most of which do not link with each other."""
    rng, rounds, of = random.Random(250), [], ngram_join.with_pivots
    monkeypatch.setattr(ngram_join, "with_pivots", lambda *a: rounds.append(1) or of(*a))
    base, texts = words(150, rng), []
    for _ in range(250):
        w = list(base)
        for _ in range(rng.randrange(1, 4)):
            w[rng.randrange(150)] = f"v{rng.randrange(100_000)}"
        texts.append(" ".join(w))
    assert sorted(tuple(r)[:3] for r in ngram_join.duplicates(frame(spark, texts)).collect()) == joined(texts)
    assert len(rounds) <= 4


def test_join_of_odd_rows(odd, empty):
    got = {r.doc_id: r.component_id for r in ngram_join.duplicates(odd).collect()}
    assert len(got) == odd.count() and got[5] == 4 and got[8] == 7 and got[1] == 1
    assert ngram_join.duplicates(empty).count() == 0
    kept = ngram_join.deduplicate(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 6, 7, 9, 10}


@pytest.mark.parametrize("shingle,percent", [(5, 80), (2, 60)])
def test_near_duplicates_of_other_parameters(spark, shingle, percent):
    """Classes against all pairs; one row of each stays, also where rows have no id or share one."""
    rng = random.Random(10)
    base = [words(n, rng, 10**6) for n in (7, 8, 9, 13, 60, 240)]
    texts = [" ".join(w) for w in base] + [" ".join([*w[:i], f"n{i}", *w[i + 1 :]]) for w in base for i in range(0, len(w), 9)] + [" ".join([*w, "end"]) for w in base] + ["a b", "A b", ""]
    sets = []
    for t in texts:
        w = t.lower().split()
        k = min(shingle, len(w))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and 100 * len(a & b) >= percent * len(a | b) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    got = ngram_join.duplicates(frame(spark, texts), shingle, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1 + i, len(s), 1 + root[i]) for i, s in enumerate(sets)]
    for ids in ([None] * len(texts), [5] * len(texts), [None if i % 2 else i for i in range(len(texts))]):
        kept = ngram_join.deduplicate(spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string"), shingle, percent).collect()
        assert len(kept) == len(set(root))


def test_pipeline_judges_near_copies_by_five_words(spark):
    w = words(600, random.Random(11), 10**6)
    near = [f"n{i}" if i % 50 == 25 else x for i, x in enumerate(w)]  # 5-grams 0.82, 3-grams 0.89
    rows = [(1, " ".join(w)), (2, " ".join(near)), (None, " ".join(w))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [1]


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(25)]
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in links:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in root.items() if any(n in (a, b) and a != b for a, b in links)}


# ---- suffix-array dedup ---------------------------------------------------------------------------------------------


def struck(texts):
    seen, out = set(), []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        out.append((1 + i, len(raw), len(raw) - len(kept), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_are_exact(spark, monkeypatch):
    rng = random.Random(6)
    shared = [" ".join(words(40, rng, 10**6)) for _ in range(4)]
    texts = ["".join(rng.choice([*shared, " ".join(words(30, rng)), "é" * rng.randrange(80), "zz" * rng.randrange(200)]) for _ in range(4)) for _ in range(60)]
    texts += [None, "", "short", "a" * 99, "a" * 100, "a" * 101, "a" * 700, texts[0], texts[0][:150]]
    want = struck(texts)
    assert sorted(map(tuple, suffix_dedup.remove(frame(spark, texts)).collect())) == want
    monkeypatch.setattr(suffix_dedup, "FEW", 2)  # most triggers go the way of many phrases
    assert sorted(map(tuple, suffix_dedup.remove(frame(spark, texts)).collect())) == want


def test_repeats_across_blocks(monkeypatch):
    """A long text gives the same windows in blocks as in one piece."""
    raw = " ".join(words(600, random.Random(7))).encode()
    whole = [w for _, _, w, _, _, _ in suffix_dedup.parse(raw)][0]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 256)
    assert np.array_equal(np.concatenate([w for _, _, w, _, _, _ in suffix_dedup.parse(raw)]), whole)


def test_removal_across_blocks(spark, monkeypatch):
    """Bytes that stand once stay at the edges of blocks, and repeats across edges go."""
    rng = random.Random(9)
    texts = [" ".join(words(800, rng, 10**6)) for _ in range(3)]
    texts += [texts[0][300:1500] + texts[1][700:2900], texts[2][37:], "ab" * 600]
    want = struck(texts)
    cloudpickle.register_pickle_by_value(suffix_dedup)  # so that workers see the small blocks
    try:
        monkeypatch.setattr(suffix_dedup, "BLOCK", 256)
        for few in (16, 2):
            monkeypatch.setattr(suffix_dedup, "FEW", few)
            assert sorted(map(tuple, suffix_dedup.remove(frame(spark, texts)).collect())) == want
    finally:
        cloudpickle.unregister_pickle_by_value(suffix_dedup)


def test_repeats_of_odd_rows(odd, empty):
    got = {r.doc_id: r for r in suffix_dedup.remove(odd).collect()}
    assert len(got) == odd.count() and got[7].n_removed < got[7].n_bytes and got[8].n_removed == got[8].n_bytes and got[8].n_spans == 1
    assert suffix_dedup.remove(empty).count() == 0


# ---- line dedup -----------------------------------------------------------------------------------------------------


def test_repeated_lines_are_those_of_the_sql(spark):
    rng = random.Random(8)
    lines = [" ".join(words(rng.choice((1, 3, 4, 5, 14)), rng)) for _ in range(30)] + ["", "  "]
    rows = [(i, "\n".join(rng.choice(lines) for _ in range(rng.randrange(12)))) for i in range(80)] + [(900, None), (901, "")]
    got = line_dedup.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    assert sorted(map(tuple, got)) == sorted(con.execute(line_dedup.ORACLE).fetchall())


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_runs_of_any_depth(spark, depth):
    rng = random.Random(depth)
    texts = ["\n".join(rng.choice("abc") for _ in range(rng.randrange(2, 14))) for _ in range(25)]
    seen, want = set(), set()
    for d, t in enumerate(texts):
        w = t.split("\n")
        for k in range(len(w) - depth + 1):
            run = tuple(w[k : k + depth])
            if run in seen:
                want |= {(d, k + i) for i in range(depth)}
            seen.add(run)
    found = line_dedup.report(frame(spark, texts), depth, 10**6)
    assert {r.doc_id - 1: r.n_removed for r in found.collect() if r.n_removed} == Counter(d for d, _ in want)


def test_lines_of_odd_rows(odd, empty):
    assert line_dedup.report(odd).count() == odd.count() and line_dedup.report(empty).count() == 0
    kept = line_dedup.apply(odd)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == set(range(1, 11)) - {8}


# ---- decontamination ------------------------------------------------------------------------------------------------


def contaminated(texts, items, k=13):
    cut = lambda t: [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    out = []
    for i, t in enumerate(texts):
        w, hit, found = cut(t), set(), set()
        for item, text in items:
            v = cut(text)
            for s in range(max(1, len(v) - k + 1) if v else 0):
                window = v[s : s + k]
                for p in range(len(w) - len(window) + 1):
                    if w[p : p + len(window)] == window:
                        hit |= set(range(p, p + len(window)))
                        found.add(str(item))
        out.append((1 + i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("block", [200_000, 7])
def test_contamination_is_exact(spark, block, monkeypatch):
    monkeypatch.setattr(decontaminate.search, "__defaults__", (decontaminate.WINDOW, decontaminate.NEAR, block))
    rng = random.Random(9)
    items = [(i, " ".join(words(rng.choice((2, 5, 13, 20, 40)), rng, 60))) for i in range(12)] + [(50, None), (51, " ... "), (52, "Zebra")]
    texts = [" ".join([*words(rng.randrange(40), rng, 60), *(rng.choice(items)[1] or "").upper().split(), *words(rng.randrange(300), rng, 60)]) for _ in range(40)] + [None, "", "zebra-ZEBRA"]
    got = decontaminate.report(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(tuple(r)[:6] for r in got.collect()) == contaminated(texts, items)


def near_places(text, item, k=13, least=10):
    """Whether some window of the item has no place in the text but ``least`` of its terms around its rarest term."""
    w, v = text.split(), item.split()
    n = Counter(w)
    for s in range(max(1, len(v) - k + 1)):
        window = v[s : s + k]
        if any(w[p : p + len(window)] == window for p in range(len(w))):
            continue
        known = [x for x in window if n[x]]
        if known:
            # ties are broken by the order of the words
            rarest = min(known, key=lambda x: (n[x], x))
            if any(len(set(window) & set(w[max(0, p - k + 1) : p + k])) >= least for p in range(len(w)) if w[p] == rarest):
                return True
    return False


def test_proximity(spark):
    rng = random.Random(21)
    item = [f"t{i:02d}" for i in range(20)]
    texts = [" ".join(["x"] * 5 + item[:6] + ["gap"] + item[6:13]), "t00 and t05", " ".join(item)]
    for _ in range(25):
        w = list(item)
        for _ in range(rng.randrange(8)):
            w[rng.randrange(len(w))] = rng.choice([*item, "y", "z"])
        texts.append(" ".join(w))
    for text in texts:
        found = decontaminate.report(frame(spark, [text]), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).first()
        exact = contaminated([text], [(1, " ".join(item))])[0][3]
        assert found.n_near_items == int(near_places(text, " ".join(item)) and not exact), text


def test_one_item_of_many_windows_lies_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate.search, "__defaults__", (decontaminate.WINDOW, decontaminate.NEAR, 5))
    item = " ".join(f"q{i}" for i in range(40))
    got = decontaminate.report(frame(spark, [item]), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (got.n_hit, got.n_items, got.n_near_items) == (40, 1, 0)


def test_contamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([(1, "one")], "item_id long, text string")
    got = {r.doc_id: r.contaminated for r in decontaminate.report(odd, bench).collect()}
    assert got[4] and got[5] and not got[1] and len(got) == odd.count()
    assert decontaminate.report(empty, bench).count() == 0 and decontaminate.report(odd, bench.where("item_id < 0")).where("contaminated").count() == 0
    assert decontaminate.clean(odd, bench).columns == odd.columns


def test_contaminated_rows_without_an_id_go(spark):
    item = " ".join(f"q{i}" for i in range(40))
    rows = [(None, item), (None, "a text of its own"), (3, item), (3, "one more text"), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = decontaminate.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(map(str, (r.text for r in kept))) == ["None", "a text of its own", "one more text"]


# ---- quality rules --------------------------------------------------------------------------------------------------


def stats_of(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    twice = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(twice))


def test_statistics_are_exact(spark, odd):
    rng = random.Random(10)
    texts = [rng.choice([" ", "\n", "\t"]).join(rng.choice(["a", "b#", "Grüße", "%%", "x\x0by", "c"]) for _ in range(rng.randrange(60))) for _ in range(60)]
    df = frame(spark, texts).unionByName(odd)
    got = sorted((r.doc_id, *(r[c] for c in quality.COUNTS[:5])) for r in quality.statistics(df).collect())
    assert got == sorted((r.doc_id, *stats_of(r.text)) for r in df.collect())


def test_rules_are_learned_and_applied(spark, empty):
    rng = random.Random(11)
    good = [" ".join(words(120, rng, 5000)) for _ in range(120)]
    bad = [" ".join(w + rng.choice(["%%%", "###"]) for w in words(120, rng, 5000)) for _ in range(60)]
    df = frame(spark, good + bad + ["tiny", None])
    labels = spark.createDataFrame([(i + 1, int(i < 120)) for i in range(0, 180, 2)], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.judge(df, labels).collect()}
    assert all(got[i] for i in range(1, 121)) and not any(got[i] for i in range(121, 183))
    kept = quality.apply(df, labels)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(range(1, 121))
    assert quality.judge(empty, labels).count() == 0 and all(r.kept for r in quality.judge(df, labels.where("doc_id < 0")).collect() if r.n_words >= 50)


# ---- license scans --------------------------------------------------------------------------------------------------


def test_licenses(spark, odd, empty):
    mit = license_scan.TEMPLATES[2][1]
    broken = mit.split()
    broken[10:12] = ["several", "changed", "words"]
    texts = ["x CC-BY y cc by", "All rights reserved. ALL RIGHTS RESERVED", "GNU general public license", f"start {mit} end", " ".join(broken), "permission is hereby granted to no one", None, ""]
    got = {r.doc_id: r for r in license_scan.report(frame(spark, texts)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (2, 1, 4, "cc-by")
    assert (got[2].n_base, got[2].labels) == (2, "reserved") and got[3].base_labels == "gpl"
    assert got[4].labels == "mit" and got[4].n_base == 0 and got[5].labels == "mit" and got[6].labels == ""
    assert (got[7].n_words, got[7].first_word, got[7].labels, got[7].score) == (0, None, "", 0.0)
    assert license_scan.report(odd).count() == odd.count() and license_scan.report(empty).count() == 0


# ---- token counts ---------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", min_size=2, max_size=5), max_size=8), st.text("abcd", max_size=20))
def test_automaton_is_greedy(pieces, word):
    vocabulary = {p.encode() for p in pieces} | {bytes([b]) for b in range(256)}
    n, w = 0, word.encode()
    while w:
        k = max(i for i in range(1, len(w) + 1) if w[:i] in vocabulary)
        n, w = n + 1, w[k:]
    assert token_counts.Automaton(vocabulary).count(word.encode()) == n


def test_counts_of_odd_rows(odd, empty):
    vocabulary = [bytes([b]) for b in range(256)] + [b"one"]
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(odd, vocabulary).collect()}
    assert got[1] == got[2] == got[3] == (0, 0) and got[4] == (1, 1) and got[9] == (2, 2)
    assert token_counts.count_tokens(empty, vocabulary).count() == 0


# ---- chat formatting ------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.text(st.sampled_from("a\\<>/s[]INST:YROLE\n"), max_size=20)), max_size=6))
def test_template_round_trip(turns):
    assert chat.turns_of("".join(x for t in turns for x in chat.marked(*t))) == turns


def test_every_reply_is_an_example(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u</s>"), (1, 2, "assistant", "a\\1"), (1, 3, "user", "v"), (1, 4, "assistant", "b"), (2, 0, "user", None), (3, 0, None, "x"), (1, 5, "user", "tail")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.examples(df).where("conv_id = 1").orderBy("example").collect()
    assert [chat.unescape(r.formatted[r.loss_start : r.loss_end]) for r in made] == ["a\\1", "b", ""] and [r.last for r in made] == [False, False, True]
    got = {r.conv_id: r for r in chat.read_back(chat.examples(df)).collect()}
    said = "".join(f"{r}\n{t}\n" for c, _, r, t in sorted(x for x in rows if x[0] == 1))
    assert (got[1].n_turns, got[1].turns_sha256, got[1].loss_chars) == (6, hashlib.sha256(said.encode()).hexdigest(), 4)
    assert got[2].loss_chars == 0 and got[3].n_turns == 1
    assert chat.read_back(chat.examples(df.where("conv_id < 0"))).count() == 0


# ---- toxicity -------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=5), st.text("abc", max_size=6))
def test_automaton_and_trie_find_one_edit(lexicon, token):
    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    assert sorted(toxicity.Trie(lexicon).within_one_edit(token)) == sorted(w for w in lexicon if edits(w, token) <= 1)
    begun = {w for w in lexicon if any(edits(w, token[:n]) <= 1 for n in range(len(token) + 1))}
    assert set(toxicity.Trie([], lexicon).within_one_edit(token)) == begun


def test_toxicity_on_held_out_rows(spark, odd, empty):
    rng = random.Random(12)
    bad = ["grumbik", "snorvel", "plodwin"]
    texts, labels = [], []
    for i in range(1200):
        w = words(60, rng, 3000)
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
            if i % 8 == 0:
                w[rng.randrange(len(w))] = "grumbok"
        texts.append(" ".join(w))
        labels.append((i + 1, int(toxic)))
    df, lab = frame(spark, texts), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.score(df, lab).collect()}
    right = sum(r.predicted == dict(labels)[d] for d, r in got.items() if r.held_out)
    assert right >= 0.97 * sum(r.held_out for r in got.values()) and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.Lexicon([], bad).kind("grumbok") == 2 and toxicity.Lexicon([], bad).kind("word") == 0
    inflected = toxicity.Lexicon(["grumbik"], [], ["grumbik"])
    assert inflected.kind("grumbiking") == 1 and inflected.kind("grumpiking") == 2 and inflected.kind("g" * 60) == 0
    assert toxicity.score(odd, lab).count() == odd.count() and toxicity.score(empty, lab).count() == 0
    assert all(r.score == 0 and r.predicted == 0 for r in toxicity.score(odd, lab.where("doc_id < 0")).collect())


def test_quotation_weighs_less():
    lexicon = toxicity.Lexicon([], ["grumbik"])
    abuse, quoted = toxicity.found_in("you grumbik go away now", lexicon), toxicity.found_in('she said the word "grumbik" was used', lexicon)
    assert abuse[0] > 0 and abuse[1] == 0 and quoted[1] > quoted[0]
