import datetime as dt
import pickle
import random
import tracemalloc

import numpy as np

from pairloom.llm import crf, defects, truncation
from pairloom.llm.endings import COMPLETE, INCOMPLETE, ITEM, Endings, Tally

AT = dt.datetime(2026, 1, 1)
OPEN = ["Good question.", "Of course.", "Thank you for asking."]
SAY = ["The soup is served with rye bread and a little butter.", "We can move you to table 12 at 19:30 if you like.", "The cook says that there is no celery in the sauce today.", "Your bill comes to 23.40 with the drinks."]
DISHES = ["roast trout", "leek tart", "barley pot", "pear cake"]
SPANISH = "La cocina necesita unos minutos para la sopa, pero puede sentarse en la mesa que está al lado."


def answer(rng, signed=True):
    parts = [rng.choice(OPEN), *rng.sample(SAY, 2)]
    if rng.random() < 0.3:
        return " ".join(parts) + " So that makes:\n" + "\n".join(f"- {d}" for d in rng.sample(DISHES, 3))
    return " ".join(parts) + (" With pleasure, your server" if signed and rng.random() < 0.3 else "")


def case(rng, k):
    return [f"We are {k} tonight and would like the {rng.choice(DISHES)} without any salt, please.", f"Is the {rng.choice(DISHES)} on table {k} still warm enough for us?"]


def made(n=1200, seed=1):
    """Cases and answers with planted defects, and what they are."""
    rng = random.Random(seed)
    cases, results, want = [], [], {}
    for k in range(n):
        turns = case(rng, k)
        cases.append((k, [*turns, "Could you answer in Spanish?"] if k % 50 == 7 else turns))
        told = {}
        for m in ("m", "n"):
            kind = rng.choice([None] * 6 + ["empty", "truncated", "refusal", "copy", "language"])
            t = answer(rng)
            if kind == "empty":
                t = rng.choice([None, "", " \n", "...", "```\n```", "<p></p>", "N/A", "[no content]", "​"])
            elif kind == "truncated":
                t = " ".join([rng.choice(OPEN), rng.choice(SAY), rng.choice(SAY)])
                t = t[: -rng.randint(3, 12)] + rng.choice(["", "…", "...", "�"])
            elif kind == "refusal":
                t = rng.choice(["I'm sorry, but I can't help with that request.", "Good question. I must decline to take part in this conversation.", "I am unable to give advice on this topic."])
            elif kind == "copy":
                t = rng.choice([turns[0], turns[1].upper(), "You asked: " + turns[0], "\n".join(turns)])
            elif kind == "language":
                t = SPANISH
                if k % 50 == 7:
                    kind = None
            told[m] = (t,)
            if kind:
                want[k, m] = kind
        results.append((k, k, AT, told))
    return cases, results, want


def frames(spark, cases, results):
    return spark.createDataFrame(results, defects.RESULTS), spark.createDataFrame(cases, "case_key bigint, turns array<string>")


def test_planted_defects_are_found(spark):
    cases, results, want = made()
    r, c = frames(spark, cases, results)
    got = {(x.result_id, x.model_name): x.defect for x in defects.defects(r.selectExpr("*", "1 as told", "'x' as lang"), c).collect()}
    for kind in ("empty", "truncated", "refusal", "copy", "language"):
        w = {k for k, v in want.items() if v == kind}
        g = {k for k, v in got.items() if v == kind}
        assert len(w & g) >= 0.95 * len(w) and len(w & g) >= 0.95 * len(g), kind


def test_refusals_that_no_word_list_names(spark):
    """Worded by hand: found by the company they keep in the sample."""
    rng = random.Random(21)
    cases, results, want = made(900, seed=5)
    plain = ["I cannot help you with that.", "My rules do not allow me to talk about this.", "I won't answer such questions."]
    worded = ["My lips are sealed.", "Best take it up with somebody else.", "That ship has sailed."]
    after = ["Try a library perhaps.", "Let us move along."]
    for k in range(1000, 1300):
        t = f"{rng.choice(plain if k % 2 else worded)} {rng.choice(after)}" if rng.random() < 0.7 else rng.choice(worded)
        cases.append((k, case(rng, k)))
        results.append((k, k, AT, {"m": (t,), "n": ("With pleasure. " + rng.choice(SAY),)}))
    r, c = frames(spark, cases, results)
    got = {(x.result_id, x.model_name): x.defect for x in defects.defects(r, c).collect() if x.result_id >= 1000}
    assert sum(got.get((k, "m")) == "refusal" for k in range(1000, 1300)) >= 285
    assert not any(m == "n" for _, m in got)


def test_the_field_does_without_any_one_feature(spark):
    """Words and neighbours make up for a feature that names a tag, but for the two that look at what the field can't see."""
    cases, results, want = made(900, seed=7)
    r, c = frames(spark, cases, results)
    for left_out, kinds in (("refuses", ("refusal",)), ("other_language", ("language",))):
        got = {(x.result_id, x.model_name): x.defect for x in defects.defects(r, c, without=(left_out,)).collect()}
        for kind in kinds:
            w = {k for k, v in want.items() if v == kind}
            g = {k for k, v in got.items() if v == kind}
            assert len(w & g) >= 0.9 * len(w) and len(w & g) >= 0.9 * len(g), kind


def test_refusals_of_few_answers_in_many_are_known(spark):
    """Ten wordings that three answers of thirty thousand have each; a sample would hardly hold all of them."""
    plain, worded = "i cannot help you with that", [f"my lips are sealed {w}" for w in "a b c d e f g h i k".split()]
    bias, topic = defects.MARK["bias"], defects.TOPIC
    rows = [([bias | topic], [f"the soup is warm {k % 97}"]) for k in range(30_000)]
    rows += [([bias | defects.MARK["refuses"], bias], [plain, w]) for w in worded for _ in range(3)] + [([], [])]
    df = spark.createDataFrame(rows, "marks array<int>, keys array<string>").repartition(5)
    assert defects.refusals(df) == frozenset(worded)
    assert defects.refusals(df.filter("false")) == frozenset()


def test_the_gradient_is_the_sum_over_blocks():
    rng = np.random.default_rng(3)
    lengths = rng.integers(1, 6, 60)
    n, half = int(lengths.sum()), int(lengths[:30].sum())
    kinds, keys = [[0], [0, 1], [1]], [rng.integers(2, 12, rng.integers(0, 4)).tolist() for _ in range(30)]
    kind, key, tags, weight = rng.integers(0, 3, n), rng.integers(0, 30, n), rng.integers(0, 5, n), rng.random(60) + 0.5
    w = crf.Chain(rng.normal(size=(12, 5)), rng.normal(size=(5, 5)), rng.normal(size=5))
    value, g = crf.Block.of(kinds, keys, kind, key, lengths, tags, weight).gradient(w)
    parts = [crf.Block.of(kinds, keys, kind[c], key[c], lengths[r], tags[c], weight[r]).gradient(w) for r, c in ((slice(30), slice(half)), (slice(30, 60), slice(half, n)))]
    total, added = defects.added(parts)
    assert np.isclose(value, total) and all(np.allclose(getattr(g, k), getattr(added, k), atol=1e-4) for k in ("emit", "move", "start"))
    w.move[1, 2] += 1e-3
    assert np.isclose((crf.Block.of(kinds, keys, kind, key, lengths, tags, weight).gradient(w)[0] - value) / 1e-3, g.move[1, 2], atol=0.05)


def test_a_block_keeps_words_that_recur_once_and_a_step_takes_little_memory():
    """Blocks are read by every step. Here 1,560 pairs recur in 3,000 clauses of 59 numbers; with each number by itself, the block had 751,644 bytes and a step took 3.9 MB."""
    rng = np.random.default_rng(4)
    word = rng.integers(1, 40, (3000, 30))
    keys = np.stack([word, np.append(40 + word[:, :-1] * 40 + word[:, 1:], np.zeros((3000, 1), int), axis=1)], axis=2).reshape(3000, -1)[:, :-1].tolist()
    n, size = 3000, 1700
    tags, weight = rng.integers(0, 5, n), rng.random(n // 3)
    block = crf.Block.of([[0]], keys, np.zeros(n, int), np.arange(n), np.full(n // 3, 3), tags, weight)
    assert len(pickle.dumps(block)) < 260_000
    w = crf.Chain(rng.normal(size=(size, 5)), rng.normal(size=(5, 5)), rng.normal(size=5))
    tracemalloc.start()
    _, g = block.gradient(w)
    assert tracemalloc.get_traced_memory()[1] < 3e6
    tracemalloc.stop()
    near = lambda x: (w.emit[0] + w.emit[keys[x]].sum(axis=0))
    assert np.allclose(block.keys.sums(w.emit.T)[:, 7] + w.emit[0], near(7), atol=1e-4)
    miss = rng.normal(size=(5, n))
    want = np.zeros((5, size))
    for k, ids in enumerate(keys):
        np.add.at(want, (slice(None), ids), miss[:, k, None])
    assert np.allclose(block.keys.back(miss, size), want, atol=1e-6) and g.emit.shape == w.emit.shape


def test_a_block_scores_clauses_that_are_alike_once():
    """A step takes time by the different clauses; there were as many scores as clauses."""
    rng = np.random.default_rng(8)
    kinds, keys = [[0], [0, 1]], [[2, 3], [4], []]
    lengths = rng.integers(1, 5, 400)
    n = int(lengths.sum())
    kind, key, tags, weight = rng.integers(0, 2, n), rng.integers(0, 3, n), rng.integers(0, 5, n), rng.random(400)
    block = crf.Block.of(kinds, keys, kind, key, lengths, tags, weight)
    assert len(block.kind) == len(block.key) == 6
    w = crf.Chain(rng.normal(size=(5, 5)), rng.normal(size=(5, 5)), rng.normal(size=5))
    want, at = 0.0, 0
    for size, u in zip(lengths, weight):
        own = [w.emit[kinds[kind[k]] + keys[key[k]]].sum(axis=0) for k in range(at, at + size)]
        t, alpha = tags[at : at + size], w.start + own[0]
        gold = w.start[t[0]] + sum(x[y] for x, y in zip(own, t)) + w.move[t[:-1], t[1:]].sum()
        for x in own[1:]:
            alpha = np.logaddexp.reduce(alpha[:, None] + w.move, axis=0) + x
        want, at = want + u * (gold - np.logaddexp.reduce(alpha)), at + size
    assert np.isclose(block.gradient(w)[0], want)


def test_clauses_with_other_numbers_are_looked_at_once():
    """Each had been looked at by itself; what depends on the numbers still does."""
    d = defects.Describer(Endings())
    told = defects.normal("is table 12 free at 19 30 today".split())
    one, other = ("Is table 12 free at 19:30 today?", "Is table 14 free at 21:45 today?")
    marks = [d.describe(t, told, 0, 0, False) for t in (one, other, one)]
    assert len(d.known) == 1 and marks[0] == marks[2] and marks[0][1] == marks[1][1] == ["is table 0 free at 0 0 today"]
    assert marks[0][0][0] & defects.MARK["echo"] and not marks[1][0][0] & defects.MARK["echo"]
    assert [d.describe(t, told, 0, 0, False)[1] for t in ("Row 12b is free.", "Row 13b is free.")] == [["row 12b is free"], ["row 13b is free"]]
    tally = Tally(["Call #"])
    for t in ("Call 5. Take room 12. Bye.", "Call 7. Take room 34. Bye."):
        tally.add(t)
    assert len(tally.seen) == 3 and {k[1]: n for k, n in tally.n.items()} == {"Call ": 2, "room #": 2, "call #": 2}


def test_words_of_keys_are_counted_once_a_key():
    names = ["the soup the soup", "", "soup", "a b a b"]
    said = defects.Said.of(names)
    words, (n, m) = said.counts(np.array([2, 5, 1, 0]), np.array([0, 0, 1, 3]))
    assert dict(zip(words, zip(n.tolist(), m.tolist()))) == {"the": (2, 0), "soup": (3, 1), "": (5, 0), "a": (0, 3), "b": (0, 3), "the soup": (2, 0), "soup the": (2, 0), "a b": (0, 3), "b a": (0, 3)}
    ids, offsets = defects.Model({"soup": 1, "the soup": 2, "b": 3}).ids(names)
    assert [sorted(ids[a:b].tolist()) for a, b in zip(offsets, offsets[1:])] == [[1, 1, 2, 2], [], [1], [3, 3]]


def test_denials_are_no_refusals_by_themselves():
    says = lambda t: defects.refuses(defects.spoken_of(t, defects.words(t)))
    for t in ("I cannot help with that request.", "Darauf gehe ich nicht ein.", "Prefiero no hablar de eso.", "Je ne peux pas répondre à cette question.", "As an AI model I can't discuss this."):
        assert says(t), t
    for t in ("We do not have that today.", "No problem, I can help you with that.", "The soup is not warm.", "I would rather have the trout.", "Es gibt heute keinen Kuchen."):
        assert not says(t), t


def test_redelivered_unknown_and_missing(spark):
    cases, results, _ = made(60)
    late = dt.datetime(2026, 1, 2)
    results += [(900, None, AT, {"m": (None,), "n": ("The soup is warm.",)}), (900, None, late, {"m": ("Fine, all is well.",)}), (901, 5, AT, {}), (902, 5, AT, None), (903, 10**9, AT, {"m": ("",)})]
    r, c = frames(spark, cases, results)
    got = {(x.result_id, x.model_name): x.defect for x in defects.defects(r, c).collect() if x.result_id >= 900}
    assert got == {(900, "m"): "empty", (903, "m"): "empty"}
    assert defects.defects(r.filter("false"), c.filter("false")).count() == 0


def test_field_limits_show_as_hazards(spark):
    rng = random.Random(2)
    rows = []
    for k in range(3000):
        n = rng.randint(20, 300)
        rows.append(("free", "chars", n))
        rows.append(("cut", "chars", min(n, 200)))
        rows.append((None, "bytes", n))
    got = truncation.hazards(spark.createDataFrame(rows, "source string, measure string, length int")).collect()
    assert [(r.source, r.length) for r in got if r.significant] == [("cut", 200)]
    last = max((r for r in got if r.source == "free"), key=lambda r: r.length)
    assert last.hazard == 1.0


def test_truncated_at_a_limit_of_bytes_or_characters(spark):
    rng = random.Random(3)
    results = []
    want = set()
    for k in range(900):
        a, b = answer(rng), answer(rng)
        if len(a) > 110 and k % 2:
            a = a[:110]
            if not a.rstrip().endswith((".", "server")):
                want.add((k, "m"))
        results.append((k, AT, {"m": (a,), "n": (b,)}))
    df = spark.createDataFrame(results, truncation.RESPONSES)
    got = {(r.result_id, r.model_name) for r in truncation.truncated(df).collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(got)
    routes = {(r.result_id, r.model_name): r.route for r in truncation.cuts(df).collect()}
    assert set(routes) == got and all(routes[k] == truncation.LIMIT for k in got & want)
    share = {r.model_name: r.share for r in truncation.report(df).collect()}
    assert share["m"] > 0.2 and share["n"] < 0.02
    assert truncation.truncated(df.filter("false")).count() == 0


def test_cuts_in_transfer_and_deliveries_at_the_same_time(spark):
    rng = random.Random(8)
    results = [(k, AT, {"m": (answer(rng),)}) for k in range(300)] + [(900, AT, {"m": (SAY[0] + " The so",)})]
    results += [(901, AT, {"m": ("The soup is ser",)}), (901, AT, {"m": ("The soup is served.",)}), (902, None, {"m": ("The so",)}), (902, AT, {"m": ("All is well.",)})]
    df = spark.createDataFrame(results, truncation.RESPONSES)
    got = {r.result_id: r.route for r in truncation.cuts(df).collect() if r.result_id >= 900}
    assert got.pop(900) == truncation.TRANSFER and set(got) <= {901}
    again = {r.result_id: r.route for r in truncation.cuts(df.repartition(3)).collect() if r.result_id == 901}
    assert again == got  # the same one of both, whatever their order


def test_endings():
    rng = random.Random(4)
    e = Endings.fit([answer(rng) for _ in range(2000)])
    for t in ("Yes.", "It is 22.00.", SAY[0], "Fine 🙂", "All right (see above)", "", SAY[0] + " With pleasure, your server", SAY[0] + "\n"):
        assert e.state(t) == COMPLETE, t
    assert e.state("So that makes:\n- leek tart\n- roast trout") == ITEM
    for t in ("The soup is ser", "The soup is…", "The soup is serv�", "So that makes:\n- leek tart\n- roast", "Your bill comes to 23.", SAY[0] + " With pleasure, your", "So that makes:"):
        assert e.state(t) == INCOMPLETE, t
    for t in ("That is all we don'", "Le chef dit que c’est l’", "He said “", "It comes with (", "The wine [", "Is it the soup? ¿", "Salt &", 'They call it "'):
        assert e.state(t) == INCOMPLETE, t
    for t in ("We call it 'house soup'", 'He calls it "the usual"', "**Enjoy**", "Served with rice (or potatoes)"):
        assert e.state(t) == COMPLETE, t


def test_endings_of_a_table_are_those_of_all_its_texts(spark):
    """A sign-off of three texts in thirty thousand is known, and a number of as few, which a sample would hardly hold."""
    rng = random.Random(14)
    texts = [SAY[k % 4] + (" Fare you well, Ida" if k % 100 == 0 else "") if k % 300 else f"So that makes:\n- roast quince {k}\n- leek tart" for k in range(30_000)]
    texts += [t for k in range(3) for t in ("Once only. Farewell to thee", "That is 7.", "It costs 5. Fine.")]
    rng.shuffle(texts)
    df = spark.createDataFrame([(k, AT, {"m": (t,), "n": (None,)}) for k, t in enumerate(texts)], truncation.RESPONSES)
    got = truncation.fit_endings(df.repartition(5))
    assert got == Endings.fit(texts)
    assert {"Farewell to thee", "Fare you well, Ida"} <= got.whole and ("costs", "#") in got.numbers
    assert truncation.fit_endings(df.filter("false")) == Endings()


def test_says_nothing():
    for t in (None, "", " ", "\t\n", "-", "...", "```\n```", "<p></p>", "N/A", "null", "[no content]", "No response", "​", "**"):
        assert truncation.says_nothing(t), t
    for t in ("No.", "5", "Sold out.", "👍", "No response from the kitchen yet, but soup is ready.", "x" * 10_000):
        assert not truncation.says_nothing(t), t


def test_the_field_learns_and_decodes_sequences():
    rng = np.random.default_rng(0)
    feats, tags, lengths = [], [], []
    for _ in range(300):
        n = int(rng.integers(1, 6))
        t = int(rng.integers(0, 2))
        for k in range(n):
            feats.append([0, 1 + t] if k == 0 else [0])  # only the first says which tag the sequence has
            tags.append(t)
        lengths.append(n)
    ids, offsets = defects.flat(feats)
    chain = crf.fit(ids, offsets, np.array(lengths), np.array(tags), 3, 2)
    assert (chain.tags(chain.scores(ids, offsets), np.array(lengths)) == tags).all()


def test_best_path_is_the_best():
    import itertools

    rng = np.random.default_rng(1)
    chain = crf.Chain(np.zeros((1, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    lengths = np.array([4, 1, 3, 4, 2])
    scores = rng.normal(size=(lengths.sum(), 3))
    got = chain.tags(scores, lengths)
    at = 0
    for n in lengths:
        s = scores[at : at + n]
        value = lambda p: chain.start[p[0]] + sum(s[i][x] for i, x in enumerate(p)) + sum(chain.move[a][b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
        assert tuple(got[at : at + n]) == max(itertools.product(range(3), repeat=int(n)), key=value)
        at += n


def test_languages():
    assert defects.LANGUAGES[defects.language("the soup is not on the table".split())] == "en"
    assert defects.LANGUAGES[defects.language("la sopa no está en la mesa".split())] == "es"
    assert defects.language("kartoffel xyz".split()) == -1
    assert defects.asked_for("Please answer in German") == 1 << defects.LANGUAGES.index("de")
    assert defects.asked_for("the French onion soup") == 0


def test_quoting_and_then_answering_is_no_copy(spark):
    cases, results, _ = made(300)
    turn = cases[0][1][0] + " " + cases[0][1][1]
    results += [(900, 0, AT, {"m": (f"> {turn}\n\nYes, it is.",), "n": (f"You asked: {cases[0][1][0]}",)})]
    r, c = frames(spark, cases, results)
    got = {(x.result_id, x.model_name): x.defect for x in defects.defects(r, c).collect() if x.result_id == 900}
    assert got == {(900, "n"): "copy"}


def test_foreign_answers_whose_words_two_languages_share(spark):
    cases, results, _ = made(600)
    told = ["Siento la espera. Divido la cuenta entre 11 y doy un recibo a cada uno.", "Le prix de la galette de lentilles marinée est de 35.50 euros, garniture comprise."]
    for t in told:
        assert defects.language(defects.WORD.findall(t.casefold())) == -1
    asks = ["We are three tonight.", "Could you answer in Spanish?"], ["We are three tonight.", "Could you answer in French?"]
    cases += [(9000, asks[0]), (9001, asks[1]), (9002, ["We are three tonight and would like the leek tart."])]
    results += [(9000, 9000, AT, {"m": (told[0],)}), (9001, 9001, AT, {"m": (told[1],)}), (9002, 9002, AT, {"m": (told[0],), "n": (told[1],)})]
    r, c = frames(spark, cases, results)
    got = {(x.result_id, x.model_name): x.defect for x in defects.defects(r, c).collect() if x.result_id >= 9000}
    assert got == {(9002, "m"): "language", (9002, "n"): "language"}


def test_where_languages_stand_to_the_case():
    en, fr, es = (defects.LANGUAGES.index(x) for x in ("en", "fr", "es"))
    counts = lambda **n: sum(v << (defects.LANE * defects.LANGUAGES.index(k)) for k, v in n.items())
    assert defects.spoken(counts(fr=12, es=13), 30, en, 0) == "other_language"
    assert defects.spoken(counts(fr=12, es=13), 30, en, 1 << fr) == "asked_language"
    assert defects.spoken(counts(fr=3, es=6), 30, en, 1 << fr) == "other_language"
    assert defects.spoken(counts(fr=5, es=6), 30, fr, 0) == "no_language"
    assert defects.spoken(counts(en=1, es=1), 2, fr, 0) == "no_language"
    assert defects.spoken(counts(fr=12, es=13), 30, -1, 1 << es) == "no_language"


def test_results_without_a_time_of_arrival_count(spark):
    from pairloom.llm import quantiles, ranking
    from pairloom.operators import evaluate

    told = {"m": ("The soup is ser", 5.0, 7)}
    rows = [(1, "b", "c", None, AT, "A", told), (2, "b", "c", None, AT, "B", {"m": ("Late.", 9.0, 9)}), (2, "b", "c", AT, AT, "A", told)]
    shape = "result_id bigint, benchmark_id string, capability string, received_at timestamp_ntz, finished_at timestamp_ntz, winner string, responses map<string, struct<response: string, latency_ms: double, tokens: bigint>>"
    df = spark.createDataFrame(rows, shape)
    runs = spark.createDataFrame([("b", [("p", "x", None), ("p", "y", None)])], "benchmark_id string, models array<struct<provider: string, model: string, alias: string>>")
    assert sorted((r.result_id, r.winner) for r in evaluate.once(df, "winner").collect()) == [(1, "A"), (2, "A")]
    assert sorted((r.metric, r.value) for r in quantiles.measures(df).collect()) == [("latency_ms", 5.0)] * 2 + [("tokens", 7.0)] * 2
    assert [tuple(r) for r in ranking.matches(df, runs).collect()] == [("p/x", "p/y", "A")] * 2
    assert sorted((r.measure, r.length) for r in truncation.lengths(df).collect()) == [("bytes", 15)] * 2 + [("chars", 15)] * 2
    assert [tuple(r) for r in truncation.report(df).collect()] == [("m", 2, 2, 0, 2, 1.0)]
