import itertools
import random

import numpy as np

from pairloom.llm import similar
from pairloom.llm.words import word_pairs

WORDS = [f"w{i}" for i in range(60)]


def made(n=60, seed=3):
    """Cases and changed copies of them, whose similarities cover the threshold on both sides."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        turns = [" ".join(rng.choices(WORDS, k=14)) for _ in range(3)]
        out.append((k, turns))
        for c in range(3):
            words = [t.split() for t in turns]
            for _ in range(rng.randint(0, 8)):
                t = rng.choice(words)
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            changed = [" ".join(t).upper() + "!" for t in words]
            rng.shuffle(changed)
            out.append((1000 + 10 * k + c, changed))
    return out


def brute(data, threshold=0.6, least=10):
    s = {k: word_pairs(t) for k, t in data}
    out = {}
    for a, b in itertools.combinations(sorted(s), 2):
        x, y = s[a], s[b]
        if len(x) >= least and len(y) >= least and len(x & y) >= threshold * len(x | y) - 1e-9:
            out[a, b] = len(x & y) / len(x | y)
    return out


def frame(spark, data):
    return spark.createDataFrame(data, "case_key bigint, turns array<string>")


def test_pairs_against_brute_force(spark):
    data = made()
    want = brute(data)
    for more in ({}, {"cap": 1, "waves": 1}, {"sketch": False}):  # no prefix is short enough with cap 1: all sets are joined
        got = {(r.rid_a, r.rid_b): r.similarity for r in similar.near_pairs(frame(spark, data), **more).collect()}
        assert set(got) <= set(want) and len(got) >= 0.98 * len(want)
        assert all(abs(got[k] - want[k]) < 1e-9 for k in got)


def test_groups_are_connected_components(spark):
    data = made(20)
    pairs = {(r.rid_a, r.rid_b) for r in similar.near_pairs(frame(spark, data)).collect()}
    parent = {x: x for p in pairs for x in p}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.case_key: (r.group_key, r.links) for r in similar.near_groups(frame(spark, data)).collect()}
    assert {k: v[0] for k, v in got.items()} == {x: root(x) for x in parent}
    assert all(got[x][1] == sum(x in p for p in pairs) for x in parent)


def test_long_chains_are_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a bigint, b bigint")
    got = {r.node: r.group for r in similar.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


def test_defined_cases(spark):
    long = " ".join(f"a{i}" for i in range(40))
    data = [(1, [long]), (2, [long.upper(), None]), (3, ["one two"]), (4, ["one two"]), (5, None), (6, []), (7, [""]), (8, [" ".join(f"a{i}" for i in range(200_00))])]
    got = [tuple(r) for r in similar.near_pairs(frame(spark, data).selectExpr("*", "1 as h", "2 as key")).collect()]
    assert got == [(1, 2, 1.0)]
    assert similar.near_pairs(frame(spark, []).limit(0)).count() == 0


def test_prefixes_are_shortened_while_few_share_them():
    """Against plain counting: the shortest depth at which at most `cap` rows share the prefix, read in pieces or at once."""
    rng = np.random.default_rng(5)
    label = np.zeros(400, np.uint64)
    for _ in range(4):
        label = label << np.uint64(16) | rng.integers(0, 3, 400).astype(np.uint64)
    key = (rng.integers(0, 4, 400) << 3).astype(np.int64)
    order = np.lexsort((label.view(np.int64), key))
    key, label, h = key[order], label[order].view(np.int64), np.arange(400)
    gain = similar.gains(0.6)
    prefix = [list(zip(key.tolist(), (label.view(np.uint64) >> np.uint64(64 - 16 * j) if j else label * 0).tolist())) for j in range(5)]
    for cap in (1, 3, 8):
        want, lost = set(), []
        for i in range(400):
            sizes = [p.count(p[i]) for p in prefix]
            depth = next((j for j in range(5) if sizes[j] <= cap), None)
            known = next((j for j in range(5) if sizes[j] <= cap - 1), 5)
            lost.append(gain[0] - gain[known])
            want |= {(i, j) for j in range(i + 1, 400) if depth is not None and prefix[depth][i] == prefix[depth][j]}
        for cuts in ((0, 400), (0, 130, 131, 290, 400)):
            got, less = set(), []
            for start, stop in zip(cuts, cuts[1:]):
                lo, hi = max(0, start - cap), min(400, stop + cap)
                x, y, part = similar.climb(key[lo:hi], label[lo:hi], h[lo:hi], start - lo, stop - lo, cap, gain)
                got |= set(zip((x + lo).tolist(), (y + lo).tolist()))
                less += part.tolist()
            assert got == want and np.allclose(less, lost)


def test_first_wave_can_reach_the_target():
    for t, r in ((0.6, 0.99), (0.8, 0.95)):
        assert similar.wave_sizes(t, r, 1)[0] * similar.gains(t)[0] >= -np.log(1 - r)


def test_crowded_prefixes_are_sent_on_by_longer_ones(spark):
    """A third of the sets differ in one pair only: with or without the sample that finds their prefixes, all is found."""
    rng = random.Random(1)
    base = [f"c{i}" for i in range(80)]
    data = [(k, [" ".join([*base, f"x{k}", f"y{k}"])]) for k in range(100)] + [(1000 + k, [" ".join(f"w{rng.randrange(5000)}" for _ in range(40))]) for k in range(200)]
    held = similar.members(similar.sets(frame(spark, data), "case_key", "turns"), 10, 64)
    hot = similar.crowded(held, 1, 5, one_in=1)
    assert 0 < len(hot) <= 5 * 5 * 256
    sent = similar.postings(held, 1, 5, hot).toPandas()
    assert len(sent) == 300 * 5 and not np.isin(sent["key"].to_numpy().view(np.uint64), hot).any()
    got = {(r.rid_a, r.rid_b) for r in similar.near_pairs(frame(spark, data)).collect()}
    assert got == set(itertools.combinations(range(100), 2))


def test_copies_are_counted_but_not_paired_in_groups(spark):
    turns = [" ".join(f"a{i}" for i in range(30))]
    near = [turns[0] + " more"]
    data = [(k, turns) for k in range(300)] + [(500, near), (501, [" ".join(f"b{i}" for i in range(30))])]
    got = {r.case_key: (r.group_key, r.links) for r in similar.near_groups(frame(spark, data).repartition(5)).collect()}
    assert got == {k: (0, 300) for k in [*range(300), 500]}
