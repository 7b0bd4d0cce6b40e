import itertools
import random

from pairloom.llm import leaks, spans
from pairloom.llm.words import folded_words


def text(rng, n, words=40):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_leaks_against_brute_force(spark):
    rng = random.Random(5)
    items = [(i, text(rng, rng.randint(5, 30), 12)) for i in range(20)] + [(20, None), (21, "")]
    docs = [(k, text(rng, 60, 12)) for k in range(40)]
    for k in range(40, 80):
        w = rng.choice(items[:20])[1].split()
        a = rng.randint(0, max(0, len(w) - 12))
        part = "... ".join(w[a : a + rng.choice([11, 12, 15])]).upper()
        docs.append((k, f"{text(rng, 20)}, {part} {text(rng, 20)}"))
    docs += [(90, None), (91, ""), (92, "x" * 5000), (93, items[0][1])]

    def windows(t):
        w = folded_words(t)
        return {tuple(w[i : i + 12]) for i in range(len(w) - 11)}

    want = {(d, i) for d, t in docs for i, s in items if windows(t) & windows(s)}
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as item_id")
    held = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'c' as category")
    for bits in (None, 4):  # tables that tell blocks apart, and such that hardly do
        got = [tuple(r) for r in leaks.leaks(df, held, bits=bits).collect()]
        assert set(got) == want and len(got) == len(want) and want
    report = {r.item_id: r.n_docs for r in leaks.leak_report(leaks.leaks(df, held), held).collect()}
    assert report == {i: sum(x == i for _, x in want) for i, _ in items}
    assert leaks.leaks(df, held.filter("false")).count() == 0 and leaks.leaks(df.filter("false"), held).count() == 0


def test_the_corpus_is_read_once_however_many_items(spark, tmp_path):
    rng = random.Random(6)
    held = spark.createDataFrame([(i, text(rng, 60, 400)) for i in range(2000)], "item_id bigint, text string")
    spark.createDataFrame([(1, held.first().text), (2, "nothing of it")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/corpus")
    found = leaks.leaks(spark.read.parquet(f"{tmp_path}/corpus"), held)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/corpus") == 1 and {(1, 0)} <= {tuple(r) for r in found.collect()}


def test_leaks_see_through_disguise(spark):
    words = "the quick brown fox jumps over a lazy dog near our old file".split()
    told = " ".join(words).replace("file", "ﬁle").replace("quick", "qu­i​ck").replace("brown", "ＢＲＯＷＮ").replace(" ", " -\n")
    docs = spark.createDataFrame([(1, f"x {told} y"), (2, " ".join(words).replace("fox", "cat"))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")
    assert [tuple(r) for r in leaks.leaks(docs, items).collect()] == [(1, 7)]


def brute(docs, least):
    seen: dict[str, set[int]] = {}
    for k, t in docs:
        for i in range(len(t or "") - least + 1):
            seen.setdefault(t[i : i + least], set()).add(k)
    pairs = {p for s in seen.values() for p in itertools.combinations(sorted(s), 2)}
    share = {}
    for k, t in docs:
        m = bytearray(len(t or ""))
        for i in range(len(m) - least + 1):
            if len(seen[t[i : i + least]]) > 1:
                m[i : i + least] = b"\1" * least
        if any(m):
            share[k] = sum(m)
    return pairs, share


def planted(seed=9, least=360):
    rng = random.Random(seed)
    letters = "abcdefgh é\n中😀"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    docs = [(k, noise(rng.randint(0, 900))) for k in range(30)]
    for k in range(30, 60, 2):
        shared = noise(least + rng.choice([-1, 0, 0, 1, 40, 900]))
        docs += [(k, noise(rng.randint(0, 200)) + shared + noise(50)), (k + 1, noise(rng.randint(0, 200)) + shared + noise(70))]
    house = noise(least + 20)
    docs += [(100 + k, noise(60) + house + noise(60)) for k in range(8)]
    copy = noise(500)
    docs += [(200, copy), (201, copy), (202, copy), (203, "x" + copy), (300, None), (301, ""), (302, "a" * 3000), (303, "ab" * 300), (304, "b" + "a" * 2999)]
    return docs


def test_spans_against_brute_force(spark):
    docs = planted()
    pairs, share = brute(docs, 360)
    df = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 as doc", "2 as digest")
    for hot in (64, 2):  # with hot chunks taken by windows, too
        got = [tuple(r) for r in spans.shared_pairs(df, hot=hot).collect()]
        assert set(got) == pairs and len(got) == len(pairs)
        assert {r.doc_id: r.n_shared for r in spans.shared_share(df, hot=hot).collect()} == share
    assert spans.shared_pairs(df.filter("false")).count() == 0


def test_boundaries_follow_the_content():
    import numpy as np

    rng = random.Random(1)
    body = "".join(rng.choice("abcdef") for _ in range(2000))
    for lead in ("", "x", "a longer beginning "):
        t = lead + body
        places = spans.cuts(spans.gear(spans.points(t)), np.array([0]), np.array([len(t)]), spans.SPREAD) - len(lead)
        inner = {int(p) for p in places if p >= spans.WINDOW + spans.SPREAD}
        if not lead:
            first = inner
        assert inner == first
    assert np.diff(sorted(first)).max() <= spans.SPREAD


def test_long_texts_are_cut_into_pieces_without_loss(spark):
    rng = random.Random(4)
    a, b = ("".join(rng.choice("abcdefgh") for _ in range(9000)) for _ in range(2))
    df = spark.createDataFrame([(1, a), (2, b[:700] + a[3300:3660] + b[700:]), (3, b[2000:2360])], "doc bigint, text string").selectExpr("*", "unhex(md5(text)) as th")
    for size in (1 << 20, 1000):
        found = spans.chunk_rows(df, 360, 64, size).collect()
        by = {}
        for r in found:
            by.setdefault(r.digest, set()).add(r.doc)
        assert {tuple(sorted(s)) for s in by.values() if len(s) > 1} == {(1, 2), (2, 3)}


def test_many_copies(spark):
    rng = random.Random(8)
    text = "".join(rng.choice("abcdefgh") for _ in range(700))
    docs = [(k, text) for k in range(40)] + [(90, "x" + text[100:500]), (91, "y" * 400)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(7)
    pairs = {tuple(r) for r in spans.shared_pairs(df).collect()}
    assert pairs == {*itertools.combinations(range(40), 2), *((k, 90) for k in range(40))}
    share = {r.doc_id: (r.rep, r.n_shared) for r in spans.shared_share(df).collect()}
    assert share == {k: (0, 700) for k in range(40)} | {90: (90, 400)}


def test_hot_chunks_that_stand_more_than_once_in_a_text(spark):
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    house = noise(350)
    docs = [(k, noise(90) + house + noise(90)) for k in range(70)]  # under 360 characters: no pair by itself
    for k in range(100, 120, 2):
        tail = house + noise(10)
        docs += [(k, noise(30) + house + noise(400) + tail + noise(30)), (k + 1, noise(70) + tail + noise(50))]
    pairs, share = brute(docs, 360)
    assert {(k, k + 1) for k in range(100, 120, 2)} <= pairs
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = [tuple(r) for r in spans.shared_pairs(df).collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    assert {r.doc_id: r.n_shared for r in spans.shared_share(df).collect()} == share


def test_every_cut_is_least_in_some_window():
    import numpy as np

    rng = np.random.default_rng(3)
    hashes = rng.integers(0, 60, 500).astype(np.uint64)
    starts, ends = np.array([0, 200, 203]), np.array([200, 203, 500])
    for spread in (1, 8, 88):
        want = set()
        for a, b in zip(starts, ends):
            for i in range(a + spans.WINDOW - 1, b - spread + 1):
                part = hashes[i : i + spread]
                want |= set((np.flatnonzero(part == part.min()) + i).tolist())
        assert set(spans.cuts(hashes, starts, ends, spread).tolist()) == want


def test_a_house_text_in_most_documents(spark):
    """Every document of a third of 20,000 holds it: the share needs no pairs, and tasks that see it often say so to the others."""
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    noise = lambda n: " ".join(rng.choices(words, k=n))
    house = noise(90)[:400]
    docs = [(k, noise(60) + house + noise(60) if k % 3 == 0 else noise(100)) for k in range(20_000)] + [(90_000, noise(60)[:80] + house[10:390] + noise(60))]
    df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4)
    share = {r.doc_id: r.n_shared for r in spans.shared_share(df).collect()}
    held = {k for k in range(0, 20_000, 3)} | {90_000}
    assert set(share) == held and all(380 <= n <= 420 for n in share.values())


def test_chunks_known_to_one_task_meet_those_of_others(spark):
    rng = random.Random(11)
    noise = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    house = noise(420)
    docs = [(k, noise(90) + house + noise(90)) for k in range(12)]
    many = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    few = spark.createDataFrame([(100, noise(50) + house[20:400]), (101, house[5:410] + noise(3))], "doc_id bigint, text string").coalesce(1)
    pairs, share = brute([*docs, *[tuple(r) for r in few.collect()]], 360)
    assert len(pairs) == 14 * 13 / 2
    got = [tuple(r) for r in spans.shared_pairs(many.union(few), hot=4).collect()]
    assert set(got) == pairs and len(got) == len(pairs)
    assert {r.doc_id: r.n_shared for r in spans.shared_share(many.union(few), hot=4).collect()} == share
