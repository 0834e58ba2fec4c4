"""Near-duplicate vectors, hard negatives and spelling variants against brute force."""

import itertools
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evidentia.llm import graph, negatives, variants, vectordups
from evidentia.llm.automaton import Automaton

RNG = np.random.default_rng(8)


# near-duplicate vectors


def linked(rows, least=0.95):
    """id -> (n_links, component_id) of (id, vector) rows with finite vectors."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    near = x @ x.T >= least
    np.fill_diagonal(near, False)
    label = dict(zip(ids, ids, strict=True))
    for _ in ids:
        new = {a: min([label[a], *(label[ids[j]] for j in np.flatnonzero(near[i]))]) for i, a in enumerate(ids)}
        if new == label:
            break
        label = new
    return {a: (int(near[i].sum()), label[a]) for i, a in enumerate(ids)}


def crowd(n=900, dim=24):
    """A third in one group of near copies, small groups, chains, copies, and single vectors."""
    base = RNG.standard_normal((n, dim))
    third = base[0] + 0.2 * RNG.standard_normal((n // 3, dim))
    pairs = base[1 : n // 6] + 0.1 * RNG.standard_normal((n // 6 - 1, dim))
    chain = [np.cos(0.25 * k) * np.eye(dim)[0] + np.sin(0.25 * k) * np.eye(dim)[1] for k in range(12)]
    copies = np.repeat(base[-3:], 5, axis=0) * np.tile([1.0, 2.0, 1.0, 0.5, 1.0], 3)[:, None]
    x = np.concatenate([base[: n // 2], third, pairs, chain, copies]).tolist()
    return [(int(i), v) for i, v in zip(RNG.permutation(len(x)) * 3, x, strict=True)]


@pytest.mark.parametrize("args", [{}, {"hot": 1 << 30, "shard": 128, "cluster": 64}, {"hot": 8, "sample": 200, "cluster": 64, "overlap": 2}])
def test_vector_links(spark, args):
    rows = crowd()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectordups.near_duplicate_vectors(df, **args).collect()}
    want = linked(rows)
    assert set(got) == set(want) and all(got[k][0] <= want[k][0] for k in want)
    assert sum(v[0] for v in got.values()) >= 0.999 * sum(v[0] for v in want.values())
    assert sum(got[k] == want[k] for k in want) >= 0.995 * len(want)


def test_loose_balls_and_their_surroundings(spark):
    """A ball's members near its edge are linked with vectors outside it."""
    dim = 16
    c = np.eye(dim)[0]
    x = [c * np.cos(a) + np.eye(dim)[k] * np.sin(a) for k in range(1, dim) for a in np.radians([0.5, 3, 7, 8.9, 9.3, 12, 16, 25])]
    rows = list(enumerate(v.tolist() for v in x))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectordups.near_duplicate_vectors(df, hot=4).collect()}
    assert got == linked(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(5, [1.0, 0.0], 1, "a"), (9, [2.0, 0.0, 0.0], 1, "b"), (7, None, 1, "c"), (3, [0.0, 0.0], 2, "d"), (4, [nan, 1.0], 2, "e"), (2, [inf, 1.0], 2, "f"), (1, [None, 1.0], 2, "g"), (None, [1.0, 0.0], 3, "h"), (8, [1e-200, 0.0], 3, "i"), (11, [0.0, 1e300], 3, "j"), (11, [0.0, 1e300], 3, "j"), (12, [], 0, "k"), (13, None, 0, "l"), (13, [0.0, -1.0], 0, "m")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, node long, links string")
    got = sorted((tuple(r) for r in vectordups.near_duplicate_vectors(df).collect()), key=repr)
    alone = [(k, 0, k, True) for k in (1, 2, 3, 4, 7, 11, 12, 13)]
    assert got == sorted([*alone, (5, 2, 5, True), (8, 2, 5, False), (9, 2, 5, False), (None, 0, None, True)], key=repr)
    assert vectordups.near_duplicate_vectors(df.limit(0)).count() == 0


def test_graph_finds_what_is_in_range():
    x = np.array([v for _, v in crowd(600)])
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    a, b = graph.FlatGraph(x).build().within(np.arange(len(x)), 0.95)
    found = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True))
    true = {(i, j) for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.95, 1)), strict=True)}
    assert len(found & true) >= 0.998 * len(true)


def test_audit_sees_what_is_missing(spark):
    rows = crowd(300)
    points = spark.createDataFrame([(i, 1, v) for i, v in rows], "node long, copies long, v array<double>")
    want = linked(rows)
    full = spark.createDataFrame([(i, n) for i, (n, _) in want.items()], "node long, links long")
    half = spark.createDataFrame([(i, n // 2) for i, (n, _) in want.items()], "node long, links long")
    assert vectordups.audited_recall(points, full, len(rows), 0.95) == 1.0
    assert vectordups.audited_recall(points, half, len(rows), 0.95) < 0.6


# hard negatives


def mined(rows, every, positives, k):
    """Brute force over (id, label, vector), the least row of an id only."""
    first = {}
    for r in sorted(((i, lab, [int(np.floor(256.0 * x)) for x in v]) for i, lab, v in rows if None not in (i, lab, v)), reverse=True):
        first[r[0]] = r
    out = []
    for i, lab, v in first.values():
        if i % every:
            continue
        score = {j: sum(a * b for a, b in itertools.zip_longest(v, w, fillvalue=0)) for j, _, w in first.values() if j != i}
        order = sorted(score, key=lambda j: (-score[j], j))
        for p in [j for j in order if first[j][1] == lab][:positives]:
            fit = [j for j in order if first[j][1] != lab and 30 * score[p] <= 100 * score[j] <= 90 * score[p]]
            out += [(i, p, r + 1, j, score[p], score[j]) for r, j in enumerate(fit[:k])]
    return sorted(out)


@pytest.mark.parametrize("args", [{}, {"numbers": 64, "anchors": 3, "sample": 16, "pivots": 4}, {"sample": 1 << 20, "pivots": 40}])
@pytest.mark.parametrize("spread", [1.0, 40.0])
def test_hard_negatives(spark, args, spread):
    x = RNG.standard_normal((300, 6)) * RNG.uniform(0.1, spread, (300, 1))
    x[200:] = np.round(x[200:], 1)
    x[250:280] = x[249]  # ties
    rows = [(i, int(RNG.integers(4)), v.tolist()) for i, v in enumerate(x)] + [(300, None, [1.0] * 6), (301, 1, None), (None, 1, [1.0] * 6), (302, 2, [9.0]), (10, 3, [5.0, 1.0]), (302, 2, [9.0]), (303, 0, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, d string, cell int").repartition(3)
    got = sorted(tuple(r) for r in negatives.hard_negatives(df, every=10, **args).collect())
    assert got and got == mined(rows, 10, 5, 10)


def test_hard_negatives_of_large_numbers_and_none(spark):
    nan = float("nan")
    rows = [(0, 1, [3e6, 1.0]), (1, 1, [3e6, 2.0]), (2, 2, [2e6, 1.0]), (3, 2, [2e6 + 1 / 256, 1.0]), (4, 2, [1e30, 1.0]), (5, 2, [nan, 1.0])]
    schema = "vec_id long, label int, embedding array<double>"
    got = sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(rows, schema)).collect())
    assert got == mined(rows[:4], 100, 5, 10) and len(got) == 2
    assert negatives.hard_negatives(spark.createDataFrame(rows[1:], schema)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([], schema)).count() == 0


# spelling variants


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", max_size=7), min_size=1, max_size=60))
def test_automata(words):
    ordered = sorted(words)
    forward = Automaton(ordered)
    assert [forward.number(w) for w in ordered] == list(range(len(ordered))) and forward.number("zz") == -1
    turned = sorted(w[::-1] for w in ordered)
    backward = Automaton(turned)

    def differ(u, v):
        """Place of the only error, by a replaced or inserted code point of v."""
        e = next((k for k, (a, b) in enumerate(zip(u, v, strict=False)) if a != b), min(len(u), len(v)))
        return e if len(u) == len(v) and u[e + 1 :] == v[e + 1 :] or len(v) == len(u) + 1 and u[e:] == v[e + 1 :] else -1

    for u in ordered:
        m = len(u) // 2
        late = sorted(v for v in ordered if v != u and differ(u, v) >= m)
        early = sorted(v for v in ordered if v != u and 0 <= differ(u, v) < m)
        assert sorted(ordered[k] for k, _ in forward.forward(u, m, len(u) + 1)) == late
        assert sorted(turned[k][::-1] for k, _ in backward.backward(u, 0, m)) == early


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:k] + v[k + 1 :] == u for k in range(len(v)))


def spelled(rows, often=5, times=5):
    n = {}
    for i, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
                w = run if h % 199 else run[: h % len(run)] + run[h % len(run) + 1 :]
                n[w] = n.get(w, 0) + (len(w) >= 6)
            run = ""
    n = {w: k for w, k in n.items() if k >= often}
    around = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(around[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: v if v is not None and n[v] >= times * n[w] else None for w, v in form.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(around[w]), n.get(form[w])) for w in n), key=repr)


@pytest.mark.parametrize("args", [{}, {"bucket": 8, "large": 3}])
def test_spelling_variants(spark, args):
    rng = random.Random(3)
    stems = ["abcdef", "aaaaaa", "aaaaaaaaaaaa", "prefixwordend", "éàçabcxyz", "×÷abcdefg"]
    words = {w for s in stems for k in range(len(s)) for c in "ab" for w in (s, s[:k] + s[k + 1 :], s[:k] + c + s[k:], s[:k] + c + s[k + 1 :])} | {"common" + "".join(x) for x in itertools.product("abc", repeat=4)}
    many = {w: rng.choice([3, 5, 6, 25, 26, 140, 900]) for w in sorted(words)}
    tokens = [w.upper() if rng.random() < 0.3 and w.isascii() else w for w, k in many.items() for _ in range(k)]
    rng.shuffle(tokens)
    rows = [(i, rng.choice([" ", ", ", "\n", "1", "-", "Ā"]).join(tokens[a : a + 700])) for i, a in enumerate(range(0, len(tokens), 700))]
    rows += [(None, "common " * 6 + "nullidword " * 7), (900, None), (901, ""), (902, "x" * 100_000 + " ") , (rows[0][0], rows[0][1])]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(4)
    got = sorted((tuple(r) for r in variants.spelling_variants(df, **args).collect()), key=repr)
    want = spelled(rows)
    assert got == want and sum(r[1] is not None for r in got) > 20 and len({r[2] for r in got} - {r[1] for r in got}) > 5
    assert any(r[2] != r[1] and r[1] for r in got)  # chains


def test_spelling_variants_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, "short words on ly")], "doc_id long, text string")
    assert variants.spelling_variants(df).count() == 0 == variants.spelling_variants(df.limit(0)).count()


def test_long_texts_and_words(spark):
    long = "spelling " * 400_000 + "q" * 200_000 + " " + ("spellingg " * 10)
    df = spark.createDataFrame([(k, long) for k in range(5)], "doc_id long, text string")
    got = {r.word: r for r in variants.spelling_variants(df).collect()}
    assert got["spellingg"].form == "spelling" and got["spelling"].n == 2_000_000 and max(map(len, got)) == 200_000
