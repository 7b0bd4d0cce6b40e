"""Long exact spans shared between records, by content-defined chunking with a gear rolling hash.

A gear hash of the last WINDOW characters is kept at every place. A place is a cut of some spread if its hash is the least
of as many consecutive places; cuts depend on nearby characters only, so insertions shift them along. A chunk goes from
a cut of spread SPREAD to the first cut of spread FINE at least `run` characters on: both its ends follow the content and
its length varies. Chunks overlap, as chunks laid end to end would have to be short, and so common, for a shared stretch
to be sure to hold one. In any stretch of `least` characters that two texts share, all cuts but those near its ends agree,
and with run = least - WINDOW - 2 (SPREAD - 1) - 2 (FINE - 1) it holds a whole chunk at the same place: texts that share such
a stretch share a chunk's digest, always. Digests are deduplicated by one shuffle; chunks of one text only end there.

Two texts with a common chunk are a candidate pair, and each difference of the chunk's places in them a diagonal, along
which the match is extended over all that follows and precedes. A text that has the same chunk more than once is compared
at all places instead.

A chunk in more than `hot` texts gives no pairs. Its texts send every window of `least` characters that holds it, at each
of its places in a text, and windows that two different texts have are shared: what a text shares is read from these
windows, without pairs; for pairs, windows that stand in the same texts are one. A task that has seen a chunk in more than
`hot` texts sends further ones to any task, so a chunk that a third of all texts have meets nowhere. Equal texts are one
record throughout and are expanded at the end, where pairs are asked for.

Defined cases: null, empty and short texts share nothing. Repetition inside one text does not count. Equal texts of
at least `least` characters share all of it. Ids must be unique; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.words import blocks, mix
from pairloom.session import materialize, small

WINDOW, SPREAD, FINE = 8, 88, 8
PRIME = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def run_length(least: int) -> int:
    """The least length of a chunk such that any shared stretch of `least` characters must hold one."""
    run = least - WINDOW - 2 * (SPREAD - 1) - 2 * (FINE - 1)
    if run < SPREAD:
        raise ValueError(f"least must be {least - run + SPREAD} or more")
    return run


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def gear(codes: np.ndarray) -> np.ndarray:
    """The hash at each place, over it and the WINDOW - 1 places before; shift by 64 / WINDOW bits a step."""
    g = mix(codes.astype(np.uint64) + np.uint64(1))
    out = np.zeros(len(g), np.uint64)
    for k in range(WINDOW):
        out[k:] += g[: len(g) - k] << np.uint64(k * 64 // WINDOW)
    return out


def sliding(x: np.ndarray, width: int, better) -> np.ndarray:
    """The best of each `width` consecutive values, by doubling."""
    n = 1
    while n < width:
        step = min(n, width - n)
        x = better(x[:-step], x[step:])
        n += step
    return x


def cuts(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, spread: int) -> np.ndarray:
    """Places whose hash is least in some `spread` consecutive places that lie within one text, WINDOW - 1 places in."""
    n = len(hashes)
    if n < spread:
        return np.zeros(0, np.int64)
    long = ends - starts >= spread + WINDOW - 1
    edges = np.zeros(n + 2, np.int32)
    np.add.at(edges, starts[long] + WINDOW - 1, 1)
    np.add.at(edges, ends[long] - spread + 1, -1)
    least = np.zeros(n + spread - 1, np.uint64)
    least[spread - 1 : n] = np.where(np.cumsum(edges[: n - spread + 1]) > 0, sliding(hashes, spread, np.minimum), np.uint64(0))
    return np.flatnonzero(sliding(least, spread, np.maximum) == hashes)


def prefix_sums(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of code * PRIME^i before each place, and INVERSE^i: together they hash any span at once."""
    n = len(codes)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(n + 1, PRIME))
        inverses = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, INVERSE))])
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(codes.astype(np.uint64)) * powers[:n])])
    return sums, inverses


def span_hash(sums: np.ndarray, inverses: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix((sums[b] - sums[a]) * inverses[a] + (b - a).astype(np.uint64))


def chunks(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place of the chunk in its text, digest) of all chunks, over a block of texts."""
    lengths = np.array([len(t) for t in texts])
    ends = np.cumsum(lengths)
    starts = ends - lengths
    codes = points("".join(texts))
    hashes = gear(codes)
    a, fine = cuts(hashes, starts, ends, SPREAD), cuts(hashes, starts, ends, FINE)
    text = np.searchsorted(ends, a, side="right")
    to = np.searchsorted(fine, a + run)
    ok = to < len(fine)
    ok[ok] &= fine[to[ok]] < ends[text[ok]]
    a, b, text = a[ok], fine[to[ok]], text[ok]
    sums, inverses = prefix_sums(codes)
    return text, a - starts[text], span_hash(sums, inverses, a + 1, b + 1).astype(np.int64)


def chunk_rows(docs: DataFrame, least: int, hot: int, block_chars: int = 1 << 20) -> DataFrame:
    """digest, text (64 bits of the text's digest), doc, place, and known: 1 if this task has seen the chunk in more than `hot`
    texts; a row with known 2 tells so to the rows of the chunk from elsewhere. A task sends a text it has seen lately only once."""
    run = run_length(least)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        times: dict[int, int] = {}
        for batch in batches:
            fresh = []
            for i, h in enumerate(batch.column(1).to_pylist()):
                if h not in seen:
                    fresh.append(i)
                    if len(seen) >= 1 << 17:
                        seen.clear()
                    seen.add(h)
            batch = batch.take(pa.array(fresh, pa.int64()))
            # any stretch of `least` characters lies whole in some piece of a long text
            pieces = [(i, at, t[at : at + block_chars + least]) for i, t in enumerate(batch.column(2).to_pylist()) for at in range(0, max(1, len(t) - least), block_chars)]
            for lo, hi in blocks([p[2] for p in pieces], block_chars):
                number, place, digest = chunks([p[2] for p in pieces[lo:hi]], run)
                row = pa.array(np.array([p[0] for p in pieces[lo:hi]], np.int64)[number])
                place = place + np.array([p[1] for p in pieces[lo:hi]], np.int64)[number]
                found, at, n = np.unique(digest, return_inverse=True, return_counts=True)
                often = np.zeros(len(found), bool)
                if len(times) >= 1 << 17:
                    times.clear()
                more = n[at] > 1
                held = np.unique(np.stack([at[more], number[more]]), axis=1)[0]  # by texts, as a text may have a chunk many times
                for k, texts in zip(*(x.tolist() for x in np.unique(held, return_counts=True))):
                    if texts > 1:
                        times[found[k]] = was = times.get(found[k], 0) + texts
                        often[k] = was > hot
                told = found[often]
                columns = (np.concatenate([x, y]) for x, y in ((digest, told), (place, told * 0 - 1), (np.where(often[at], 1, 0), told * 0 + 2)))
                digest, place, known = (pa.array(x) for x in columns)
                row = pa.concat_arrays([row, pa.nulls(len(told), pa.int64())])
                yield pa.RecordBatch.from_arrays([digest, batch.column(1).take(row).fill_null(0), batch.column(0).take(row).fill_null(0), place, known.cast(pa.int8())], ["digest", "text", "doc", "place", "known"])

    return docs.select("doc", F.conv(F.substring(F.hex("th"), 1, 15), 16, 10).cast("bigint").alias("text_id"), "text").mapInArrow(scan, "digest bigint, text bigint, doc bigint, place bigint, known tinyint")


def repeated(rows: DataFrame, hot: int) -> DataFrame:
    """digest, doc, place, again (the text has it more than once), hot: chunks of more than one text, once for each text."""
    sent = rows.repartition(F.when(F.col("known") == 1, F.xxhash64("doc")).otherwise(F.col("digest"))).sortWithinPartitions("digest")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def read(stop: int) -> pa.RecordBatch:
            """The first `stop` rows, which are whole groups."""
            digest, text, doc, place, known = (x[:stop] for x in rest)
            order = np.lexsort((place, doc, text, known == 2, digest))
            digest, text, doc, place, known = (x[order] for x in (digest, text, doc, place, known))
            new = np.ones(len(digest), bool)
            new[1:] = (digest[1:] != digest[:-1]) | (text[1:] != text[:-1])  # a text once, by its least document
            new &= known < 2
            group = np.cumsum(np.concatenate([[True], digest[1:] != digest[:-1]])) - 1
            n = np.bincount(group, weights=new)
            common = np.bincount(group, weights=known) > 0
            one = np.flatnonzero(new)
            own = np.maximum(np.cumsum(new) - 1, 0)
            again = known < 2
            again &= (doc == doc[one][own]) & (place != place[one][own]) if len(one) else False
            same = np.bincount(own, weights=again, minlength=len(one)) > 0
            wide = common | (n > hot)
            kept = ((n > 1) | common)[group[one]]
            at = one[kept]
            return pa.RecordBatch.from_arrays([pa.array(digest[at]), pa.array(doc[at]), pa.array(place[at]), pa.array(same[kept]), pa.array(wide[group[at]])], ["digest", "doc", "place", "again", "hot"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            if stop := int(np.searchsorted(rest[0], rest[0][-1])):
                yield read(stop)
                rest = [x[stop:] for x in rest]
        if rest is not None and len(rest[0]):
            yield read(len(rest[0]))

    return materialize(sent.mapInArrow(scan, "digest bigint, doc bigint, place bigint, again boolean, hot boolean"), "chunks")


def window_hashes(text: str, least: int) -> np.ndarray:
    codes = points(text)
    a = np.arange(len(codes) - least + 1)
    return span_hash(*prefix_sums(codes), a, a + least)


def stretches(a: str, b: str, least: int, diagonals: list[int] | None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The parts of a and of b that lie in shared stretches of `least` characters: along the given differences of place,
    or anywhere."""
    x, y = points(a), points(b)
    if min(len(x), len(y)) < least:
        return [], []
    in_a, in_b = np.zeros(len(x) + 1, np.int32), np.zeros(len(y) + 1, np.int32)
    if diagonals is None:
        for mine, other, marks in ((a, b, in_a), (b, a, in_b)):
            at = np.flatnonzero(np.isin(window_hashes(mine, least), window_hashes(other, least)))
            np.add.at(marks, at, 1)
            np.add.at(marks, at + least, -1)
    for d in set(diagonals or ()):
        lo, hi = max(0, d), min(len(x), len(y) + d)
        change = np.diff(np.concatenate([[False], x[lo:hi] == y[lo - d : hi - d], [False]]).astype(np.int8))
        begin, end = np.flatnonzero(change == 1) + lo, np.flatnonzero(change == -1) + lo
        long = end - begin >= least
        for marks, shift in ((in_a, 0), (in_b, d)):
            np.add.at(marks, begin[long] - shift, 1)
            np.add.at(marks, end[long] - shift, -1)
    return covered(in_a), covered(in_b)


def covered(marks: np.ndarray) -> list[tuple[int, int]]:
    """Intervals where the running sum of marks is above 0."""
    change = np.diff(np.concatenate([[0], (np.cumsum(marks) > 0).astype(np.int8)]))
    return list(zip(np.flatnonzero(change == 1).tolist(), np.flatnonzero(change == -1).tolist()))


def prepare(docs: DataFrame, doc_id: str, text: str, least: int) -> DataFrame:
    held = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).filter(F.length("text") >= least)
    return held.withColumn("th", F.unhex(F.md5("text")))


def classes(long: DataFrame) -> DataFrame:
    """doc, rep of the texts that occur more than once; rep is the least doc with that text."""
    ids = long.select("th", "doc")
    groups = ids.groupBy("th").agg(F.min("doc").alias("rep"), F.count("*").alias("n")).filter("n > 1")
    return ids.join(groups, "th").select("doc", "rep")


def named(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """Pairs with each text named by the least doc that has it."""
    for c in "ab":
        pairs = pairs.join(copies.select(F.col("doc").alias(c), F.col("rep").alias(f"{c}__")), c, "left").withColumn(c, F.coalesce(f"{c}__", c)).drop(f"{c}__")
    return pairs


def candidates(found: DataFrame) -> DataFrame:
    """a < b, diagonals (null: compare all places) of texts, each by one doc that has it, with a common chunk that is not hot."""
    few = found.filter("not hot")
    both = few.alias("p").join(few.alias("q"), "digest").filter("p.doc < q.doc")
    way = F.when(F.col("p.again") | F.col("q.again"), None).otherwise(F.col("p.place") - F.col("q.place"))
    pairs = both.select(F.col("p.doc").alias("a"), F.col("q.doc").alias("b"), way.alias("d"))
    return pairs.groupBy("a", "b").agg(F.collect_set("d").alias("ds"), F.bool_or(F.col("d").isNull()).alias("all")).select("a", "b", F.when(~F.col("all"), F.col("ds")).alias("diagonals"))


def windows(long: DataFrame, found: DataFrame, least: int) -> DataFrame:
    """w, v (two digests of a window), doc, place: the windows around hot chunks that more than one text has."""
    run = run_length(least)
    reach = run + FINE
    many = found.filter("hot").groupBy("doc").agg(F.collect_set("digest").alias("hot"))

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for doc, text, digests in zip(pdf["doc"], pdf["text"], pdf["hot"]):
                codes = points(text)
                first = np.arange(len(codes) - least + 1)
                _, pos, digest = chunks([text], run)
                at = pos[np.isin(digest, digests)]  # all places of a chunk, as any may lie in a shared stretch
                edges = np.zeros(len(first) + 1, np.int64)
                np.add.at(edges, np.clip(at + 1 + run - least, 0, len(first)), 1)
                np.add.at(edges, np.minimum(at + 2, len(first)), -1)
                starts = np.flatnonzero(np.cumsum(edges)[:-1])
                if len(starts):
                    w, v = (span_hash(*prefix_sums(c), starts, starts + least).astype(np.int64) for c in (codes, codes.astype(np.uint64) * OTHER))
                    yield pd.DataFrame({"w": w, "v": v, "doc": doc, "place": starts})

    sent = materialize(long.select("doc", "text").join(small(many), "doc").mapInPandas(send, "w bigint, v bigint, doc bigint, place bigint"), "windows")
    shared = sent.groupBy("w", "v").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("w", "v")
    return sent.join(shared, ["w", "v"])


def window_pairs(shared: DataFrame) -> DataFrame:
    """a < b of every two texts with a common window; windows that stand in the same texts are taken as one."""
    one = materialize(shared.select("w", "v", "doc").distinct(), "held")
    mark = lambda seed: F.sum(F.xxhash64("doc", F.lit(seed)).cast("decimal(38,0)"))
    alike = one.groupBy("w", "v").agg(F.count("*").alias("n"), mark(1).alias("m"), mark(2).alias("k")).groupBy("n", "m", "k").agg(F.min(F.struct("w", "v")).alias("s")).select("s.w", "s.v")
    held = one.join(alike, ["w", "v"])
    return held.alias("p").join(held.alias("q"), ["w", "v"]).filter("p.doc < q.doc").select(F.col("p.doc").alias("a"), F.col("q.doc").alias("b")).distinct()


def with_texts(long: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs with both texts; only texts of some pair are moved."""
    ids = materialize(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "ids")
    texts = long.select("doc", "text").join(small(ids), "doc")
    left = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(left, "a").join(right, "b")


def verified(long: DataFrame, pairs: DataFrame, least: int) -> DataFrame:
    """a, b and the intervals of each that lie in shared stretches of at least `least` characters."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, ds, ta, tb in zip(pdf["a"], pdf["b"], pdf["diagonals"], pdf["text_a"], pdf["text_b"]):
                in_a, in_b = stretches(ta, tb, least, None if ds is None else list(ds))
                if in_a:
                    out.append((a, b, in_a, in_b))
            if out:
                yield pd.DataFrame(out, columns=["a", "b", "in_a", "in_b"])

    return with_texts(long, pairs).mapInPandas(compare, "a bigint, b bigint, in_a array<array<int>>, in_b array<array<int>>")


def shared_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 360, hot: int = 64) -> DataFrame:
    """doc_id_a < doc_id_b of every two documents that share a stretch of at least `least` characters, copies included."""
    long = prepare(docs, doc_id, text, least)
    copies = materialize(classes(long), "copies")
    found = repeated(chunk_rows(long, least, hot), hot)
    pairs = verified(long, materialize(candidates(found), "candidates"), least).select("a", "b")
    if not found.filter("hot").isEmpty():
        pairs = pairs.union(window_pairs(windows(long, found, least)))
    pairs = named(pairs, small(copies)).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    # a text without copies stands for itself
    members = small(copies.select(F.col("rep").alias("r"), F.col("doc").alias("m")))
    wide = pairs.join(members.withColumnsRenamed({"r": "a", "m": "ma"}), "a", "left").join(members.withColumnsRenamed({"r": "b", "m": "mb"}), "b", "left")
    wide = wide.select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
    same = copies.alias("p").join(copies.alias("q"), "rep").filter("p.doc < q.doc").select(F.col("p.doc").alias("x"), F.col("q.doc").alias("y"))
    return wide.union(same).select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def shared_share(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = 360, hot: int = 64) -> DataFrame:
    """Per document with a shared stretch: its characters, how many lie in shared stretches, their share, and rep, the
    least document with the same text. Copies share all of their text and are not compared with each other; texts of a hot
    chunk are compared through its windows, so no more than `hot` texts of a chunk are paired."""
    long = prepare(docs, doc_id, text, least)
    copies = materialize(classes(long), "copies")
    found = repeated(chunk_rows(long, least, hot), hot)
    pairs = materialize(verified(long, materialize(candidates(found), "candidates"), least), "stretches")
    either = pairs.select("a", F.explode("in_a").alias("s")).union(pairs.select("b", F.explode("in_b")))
    spans = either.select(F.col("a").alias("doc"), F.col("s")[0].alias("lo"), F.col("s")[1].alias("hi"))
    if not found.filter("hot").isEmpty():
        # copies have the windows of each other, and share all of their text anyway
        spans = spans.union(windows(long, found, least).select("doc", F.col("place").cast("int"), (F.col("place") + least).cast("int")))
    names = small(copies)
    spans = spans.join(names, "doc", "left").select(F.coalesce("rep", "doc").alias("rep"), "lo", "hi").distinct()
    order = Window.partitionBy("rep").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.greatest("lo", F.coalesce(F.max("hi").over(order), F.lit(0)))
    parts = spans.select("rep", F.greatest(F.lit(0), F.col("hi") - beyond).alias("n"))
    per = parts.groupBy("rep").agg(F.sum("n").alias("n_shared"))
    ids = long.select("doc", F.length("text").cast("bigint").alias("n_chars")).join(names, "doc", "left")
    ids = ids.withColumn("copied", F.col("rep").isNotNull()).withColumn("rep", F.coalesce("rep", "doc"))
    out = ids.join(per, "rep", "left").filter("copied or n_shared is not null")
    n = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.col("n_shared"))
    return out.select(F.col("doc").alias("doc_id"), "rep", "n_chars", n.alias("n_shared"), F.round(n / F.col("n_chars"), 6).alias("share"))
