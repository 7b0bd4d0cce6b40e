"""Near-duplicate records by a MinHash LSH forest with exact verification.

A record is the set of adjacent word pairs inside its turns; two records count if their sets, of at least `min_pairs`
each, have a Jaccard similarity of `threshold` or more. Records with equal sets are one from the start.

Each tree of the forest orders all sets by a label, the sequence of DEEPEST MinHash values of its own, so that sets with a
common prefix lie side by side: a sorted trie. A set's prefix starts at full depth and is shortened, in every tree for
itself, while no more than `cap` sets share it, to SHORTEST values at least; the sets that then share it are its
candidates. A pair at the threshold shares a prefix of d values with probability threshold^d, so a set whose prefixes
have depths d_t finds such a pair with probability 1 - prod(1 - threshold^d_t). A set is given trees in waves until that
reaches the target recall: sets in thin regions, with short prefixes, are done after the first wave, others go on among
themselves. Sets that no number of trees would help, as their prefixes are crowded at every depth, are joined with each
other by prefix filtering over their rarest word pairs, which misses nothing. As a pair is found if it is found from
either side, these two ways together give every pair at the threshold the target recall at least.

Prefixes that a large part of the sets have in common are found on a sample by a hash, which decides about nothing but the
way of rows: they are sent on by longer prefixes, so no subtree meets in one task. The tries are read in a stream.

A bit sketch of `bits` further MinHash values, a multiple of 64, drops candidates far below the threshold (four standard deviations;
sketch=False leaves this out), and the rest are compared exactly on their texts.

Defined cases: null and empty turns, and null entries, have no pairs; a record below `min_pairs` is near nothing. Equal
sets have similarity 1. Ids must be unique; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.words import CODES, digest64, mix, word_pairs, words
from pairloom.session import materialize, small

SHORTEST, DEEPEST = 4, 8
LEVEL = 16  # bits of a label below its first SHORTEST values


def gains(threshold: float) -> np.ndarray:
    """-log(1 - threshold^d) for d = SHORTEST .. DEEPEST: what a prefix of that depth adds to the recall's logarithm; then 0."""
    return np.append(-np.log1p(-(threshold ** np.arange(SHORTEST, DEEPEST + 1.0))), 0.0)


def wave_sizes(threshold: float, recall: float, waves: int) -> list[int]:
    """Trees of each wave: the first can just do for sets whose prefixes are nearly all short, each later one adds a share of it."""
    first = math.ceil(-math.log1p(-recall) / gains(threshold)[0] * 1.06) + 1
    return [first, *(max(1, math.ceil(first * 2**k / 3)) for k in range(waves - 1))]


def pair_codes(records: list[list[str | None] | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word pairs of each record as sorted distinct 64-bit codes, one record after the other, and their numbers."""
    said: list[str] = []
    lengths, owner = [], []
    for k, turns in enumerate(records):
        for t in turns or ():
            if t:
                w = words(t)
                said += w
                lengths.append(len(w))
                owner.append(k)
    if len(said) < 2:
        return np.zeros(0, np.uint64), np.zeros(len(records), np.int64)
    c = np.fromiter(map(CODES.__getitem__, said), np.uint64, len(said))
    turn = np.repeat(np.arange(len(lengths)), lengths)
    inside = turn[1:] == turn[:-1]
    pair = mix(c[:-1] + mix(c[1:]))[inside]
    record = np.repeat(np.array(owner), lengths)[:-1][inside]
    order = np.lexsort((pair, record))
    pair, record = pair[order], record[order]
    fresh = np.ones(len(pair), bool)
    fresh[1:] = (pair[1:] != pair[:-1]) | (record[1:] != record[:-1])
    return pair[fresh], np.bincount(record[fresh], minlength=len(records))


def coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def minhashes(codes: np.ndarray, counts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each of the multiply-add hashes over each set (a row a set), mixed so that all bits serve."""
    starts = np.cumsum(counts) - counts
    out = np.empty((len(a), len(counts)), np.uint32)
    for k in range(len(a)):
        np.minimum.reduceat(codes * a[k] + b[k], starts, out=out[k])
    return mix(out.T)


def sets(records: DataFrame, record_id: str, turns: str) -> DataFrame:
    return records.select(F.col(record_id).cast("bigint").alias("rid"), F.col(turns).alias("turns")).filter("turns is not null")


def members(held: DataFrame, min_pairs: int, bits: int) -> DataFrame:
    """rid, set digest, and once for each set a task has not seen lately: number of pairs, the upper halves of their codes
    and the sketch (the lowest bits of MinHash values), of every record with enough pairs. The one reading of all texts."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(bits, 2)
        seen: set[int] = set()
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            rids = batch.column(0).to_pylist()
            codes, counts = pair_codes(batch.column(1).to_pylist())
            ends = np.cumsum(counts).tolist()
            rows: list[list] = []
            fresh = []
            for k, (rid, n, end) in enumerate(zip(rids, counts.tolist(), ends)):
                if n < min_pairs:
                    continue
                own = codes[end - n : end]
                h = digest64(own.tobytes())
                if h in seen:
                    rows.append([rid, h, None, None, None])
                    continue
                if len(seen) >= 1 << 17:
                    seen.clear()
                seen.add(h)
                upper = (own >> np.uint64(32)).astype(np.uint32)
                fresh.append(upper)
                rows.append([rid, h, n, upper.tobytes(), None])
            if fresh:
                signs = minhashes(np.concatenate(fresh), np.array([len(x) for x in fresh]), a, b) & np.uint64(1)
                sketches = iter(np.ascontiguousarray(np.packbits(signs.astype(np.uint8), axis=1)).view(np.int64).tolist())
                for r in rows:
                    if r[2] is not None:
                        r[4] = next(sketches)
            types = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["rid", "h", "n", "codes", "bits"])

    return held.mapInArrow(scan, "rid bigint, h bigint, n int, codes binary, bits array<bigint>")


def unpacked(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of a column of sets, one after the other, and their numbers."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), np.uint32), np.array([len(x) // 4 for x in parts], np.int64)


def subtrees(values: np.ndarray, first_tree: int, trees: int) -> list[np.ndarray]:
    """Keys of the prefixes of SHORTEST .. DEEPEST values of each set in each tree; the lowest three bits tell the depth."""
    values = values.reshape(-1, trees, DEEPEST)
    key = np.broadcast_to(mix(np.arange(first_tree + 1, first_tree + trees + 1)), values.shape[:2])
    out = []
    for j in range(DEEPEST):
        key = mix(key ^ values[:, :, j])
        if j >= SHORTEST - 1:
            out.append((key & ~np.uint64(7)) | np.uint64(j - SHORTEST + 1))
    return out


def crowded(held: DataFrame, first_tree: int, trees: int, share: int = 256, one_in: int = 64, least: int = 64) -> np.ndarray:
    """Keys of prefixes that more than 1 / `share` of the sets have, by a sample of one in `one_in`: at most `share` a tree and depth."""
    sample = held.filter(F.pmod(F.xxhash64("h"), F.lit(one_in)) == 0)
    total = sample.count()
    if total < least:
        return np.zeros(0, np.uint64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(trees * DEEPEST, first_tree)
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            codes, counts = unpacked(batch.column(1))
            keys = np.concatenate([k.ravel() for k in subtrees(minhashes(codes, counts, a, b), first_tree, trees)])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], ["key"])

    counted = sample.select("h", "codes").mapInArrow(scan, "key bigint").groupBy("key").count()
    found = counted.filter(F.col("count") >= max(least, total / share)).select("key").collect()
    return np.sort(np.array([r.key for r in found], np.int64).view(np.uint64))


def postings(held: DataFrame, first_tree: int, trees: int, hot: np.ndarray) -> DataFrame:
    """key of the subtree, rest of the label, set digest, of each set in each tree. The subtree is that of the first SHORTEST
    values, or of more where these are crowded; where all are, the row goes alone."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(trees * DEEPEST, first_tree)
        for batch in (b.slice(i, 256) for b in batches for i in range(0, b.num_rows, 256)):
            codes, counts = unpacked(batch.column(1))
            values = minhashes(codes, counts, a, b)
            digests = np.repeat(batch.column(0).to_numpy(), trees)
            keys = [k.ravel() for k in subtrees(values, first_tree, trees)]
            below = (values.reshape(-1, DEEPEST) >> np.uint64(64 - LEVEL))[:, SHORTEST:]
            label = np.zeros(len(below), np.uint64)
            for j in range(DEEPEST - SHORTEST):
                label = label << np.uint64(LEVEL) | below[:, j]
            key = keys[0].copy()
            at = np.arange(len(key)) if len(hot) else np.zeros(0, np.int64)
            for longer in (*keys[1:], mix(digests.view(np.uint64) ^ keys[-1]) | np.uint64(7)):
                at = at[np.isin(key[at], hot)]
                key[at] = longer[at]
                label[at] <<= np.uint64(LEVEL)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), label.view(np.int64), digests)], ["key", "label", "h"])

    return held.select("h", "codes").mapInArrow(scan, "key bigint, label bigint, h bigint")


def climb(key: np.ndarray, label: np.ndarray, h: np.ndarray, start: int, stop: int, cap: int, gain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the rows start .. stop of a sorted trie: the places of candidate pairs, and how much less than a prefix of
    SHORTEST values each row's own adds. The rows `cap` before and after must be there where there are any."""
    n, levels = len(key), DEEPEST - SHORTEST + 1
    taken = np.minimum((key & np.int64(7)).astype(np.int8), levels)  # levels that the subtree itself stands for
    common: list[np.ndarray] = []
    beside = np.zeros((levels, n), np.int16)
    for k in range(1, min(cap, n - 1) + 1):
        x = (label[k:] ^ label[:-k]).view(np.uint64)
        shared = sum(((x >> np.uint64(LEVEL * j)) == 0).astype(np.int8) for j in range(levels - 1))
        shared[key[k:] != key[:-k]] = -1
        common.append(shared)
        for j in range(levels):
            near = shared >= j
            beside[j, :-k] += near
            beside[j, k:] += near
    last = levels - taken  # levels below the subtree, itself included
    open_, known = np.full(n, 99, np.int8), np.full(n, levels, np.int8)
    for j in range(levels - 1, -1, -1):
        fits = j < last
        open_[fits & (beside[j] < cap)] = j
        sure = fits & (beside[j] < cap - 1)  # a partner that joins must not crowd the prefix
        known[sure] = (taken + j)[sure]
    pairs = []
    for k, shared in enumerate(common, 1):
        i = np.flatnonzero(shared[start:stop] >= open_[start : min(stop, n - k)]) + start
        pairs.append((i, i + k))
    left, right = (np.concatenate([p[s] for p in pairs]) if pairs else np.zeros(0, np.int64) for s in (0, 1))
    return left, right, (gain[0] - gain[known])[start:stop]


def forest(held: DataFrame, first_tree: int, trees: int, threshold: float, cap: int) -> DataFrame:
    """Candidate pairs (a, b), and rows with b null and lost: what a set's recall lacks in a tree."""
    gain = gains(threshold)
    rows = postings(held, first_tree, trees, crowded(held, first_tree, trees)).repartition("key").sortWithinPartitions("key", "label", "h")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] | None = None
        start = 0

        def read(final: bool) -> pa.RecordBatch:
            nonlocal rest, start
            key, label, h = rest
            stop = len(key) if final else max(start, len(key) - cap)
            left, right, lost = climb(key, label, h, start, stop, cap, gain)
            less = np.flatnonzero(lost > 0)
            a = np.concatenate([np.minimum(h[left], h[right]), h[start + less]])
            b = pa.concat_arrays([pa.array(np.maximum(h[left], h[right])), pa.nulls(len(less), pa.int64())])
            drop = max(0, stop - cap)
            rest, start = (key[drop:], label[drop:], h[drop:]), stop - drop
            return pa.RecordBatch.from_arrays([pa.array(a), b, pa.array(np.concatenate([np.zeros(len(left)), lost[less]]))], ["a", "b", "lost"])

        for batch in batches:
            now = tuple(batch.column(k).to_numpy() for k in range(3))
            rest = now if rest is None else tuple(np.concatenate(x) for x in zip(rest, now))
            if len(now[0]):  # the same set twice in a tree: two tasks have seen it
                again = np.zeros(len(rest[0]), bool)
                again[1:] = (rest[0][1:] == rest[0][:-1]) & (rest[1][1:] == rest[1][:-1]) & (rest[2][1:] == rest[2][:-1])
                rest = tuple(x[~again] for x in rest)
                yield read(False)
        if rest is not None and len(rest[0]):
            yield read(True)

    return materialize(rows.mapInArrow(scan, "a bigint, b bigint, lost double"), "forest")


def dense_pairs(held: DataFrame, threshold: float) -> DataFrame:
    """Candidate pairs among some sets by prefix filtering: of two similar sets the shorter has one of its first
    n - ceil(2t / (1 + t) n) + 1 rarest word pairs among the n - ceil(t n) + 1 rarest of the longer."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, counts = unpacked(batch.column(1))
            h = np.repeat(batch.column(0).to_numpy(), counts)
            n = np.repeat(counts, counts).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n), pa.array(codes.view(np.int32))], ["h", "n", "code"])

    one = materialize(held.select("h", "codes").mapInArrow(scan, "h bigint, n int, code int").distinct(), "dense")
    rarity = one.groupBy("code").agg(F.count("*").alias("df"))
    ranked = one.join(rarity, "code").withColumn("place", F.row_number().over(Window.partitionBy("h").orderBy("df", "code")))
    reach = lambda s: F.col("n") - F.ceil(F.col("n") * s - 1e-9) + 1
    kept = materialize(ranked.filter((F.col("df") > 1) & (F.col("place") <= reach(threshold))).withColumn("short", F.col("place") <= reach(2 * threshold / (1 + threshold))), "rarest")
    p, q = kept.filter("short").alias("p"), kept.alias("q")
    pairs = p.join(q, "code").filter((F.struct("p.n", "p.h") < F.struct("q.n", "q.h")) & (F.col("p.n") >= threshold * F.col("q.n")))
    return pairs.select(F.least("p.h", "q.h").alias("a"), F.greatest("p.h", "q.h").alias("b"))


def candidates(by: DataFrame, threshold: float, recall: float, cap: int, waves: int) -> DataFrame:
    """Distinct pairs a < b of set digests, from the waves of trees and from the sets that remain after them."""
    target, best = -math.log1p(-recall), float(gains(threshold)[0])
    held, first, pairs = by.filter("codes is not null"), 1, None
    reached = None  # h, have: what the trees so far add up to, of the sets whose recall is below the target
    for trees in wave_sizes(threshold, recall, waves):
        if reached is not None:
            held = by.filter("codes is not null").join(small(reached.select("h")), "h", "leftsemi")
        found = forest(held, first, trees, threshold, cap)
        first += trees
        more = found.filter("b is not null").select("a", "b")
        pairs = more if pairs is None else pairs.union(more)
        lost = found.filter("b is null").groupBy(F.col("a").alias("h")).agg(F.sum("lost").alias("lost"))
        if reached is None:
            now = lost.select("h", (F.lit(trees * best) - F.col("lost")).alias("have"))
        else:
            now = reached.join(lost, "h", "left").select("h", (F.col("have") + trees * best - F.coalesce("lost", F.lit(0.0))).alias("have"))
        reached = materialize(now.filter(F.col("have") < target), "reached")
        if reached.isEmpty():
            return pairs.distinct()
    dense = by.filter("codes is not null").join(small(reached.select("h")), "h", "leftsemi")
    return pairs.union(dense_pairs(dense, threshold)).distinct()


def near_sets(held: DataFrame, by: DataFrame, min_pairs: int, threshold: float, recall: float, cap: int, waves: int, bits: int, sketch: bool) -> DataFrame:
    """Verified pairs a < b of set digests with the sizes of their intersection and union; `by` has the members."""
    pairs = candidates(by, threshold, recall, cap, waves)
    parts = [f"s{k}" for k in range(bits // 64)]
    sketches = by.filter("n is not null").groupBy("h").agg(F.any_value("n").alias("n"), *(F.any_value(F.col("bits")[k]).alias(c) for k, c in enumerate(parts)))
    one = small(materialize(sketches, "sketches"), 32 << 20)
    left, right = (one.select(F.col("h").alias(s), *(F.col(c).alias(f"{c}_{s}") for c in ("n", *parts))) for s in "ab")
    n_a, n_b, far = F.col("n_a"), F.col("n_b"), F.lit(0)
    for c in parts:
        far = far + F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    near = (n_a >= threshold * n_b) & (n_b >= threshold * n_a)
    if sketch:
        agree = (1 + threshold) / 2
        near &= far <= bits - math.floor(bits * agree - 4 * math.sqrt(bits * agree * (1 - agree)))
    kept = materialize(pairs.join(left, "a").join(right, "b").filter(near).select("a", "b"), "near")
    wanted = small(materialize(kept.select(F.col("a").alias("h")).union(kept.select("b")).distinct(), "wanted"))
    texts = materialize(representatives(held, by, wanted), "texts")
    left = texts.select(F.col("h").alias("a"), F.col("turns").alias("ta"))
    right = texts.select(F.col("h").alias("b"), F.col("turns").alias("tb"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, ta, tb in zip(pdf["a"], pdf["b"], pdf["ta"], pdf["tb"]):
                x, y = word_pairs(ta), word_pairs(tb)
                both = len(x & y)
                if both >= threshold * (either := len(x) + len(y) - both) - 1e-9:
                    out.append((a, b, both, either))
            yield pd.DataFrame(out, columns=["a", "b", "both", "either"])

    return kept.join(left, "a").join(right, "b").mapInPandas(compare, "a bigint, b bigint, both int, either int")


def representatives(held: DataFrame, by: DataFrame, wanted: DataFrame) -> DataFrame:
    """The turns of one record for each wanted set."""
    ids = by.join(wanted, "h").groupBy("h").agg(F.min("rid").alias("rid"))
    return held.join(small(materialize(ids, "reps")), "rid").select("h", "turns")


def near_pairs(records: DataFrame, record_id: str = "case_key", turns: str = "turns", threshold: float = 0.6, min_pairs: int = 10, recall: float = 0.99, cap: int = 8, waves: int = 4, bits: int = 256, sketch: bool = True) -> DataFrame:
    """rid_a < rid_b, similarity of every near-duplicate pair of records, equal sets included."""
    held = sets(records, record_id, turns)
    by = materialize(members(held, min_pairs, bits), "members")
    found = near_sets(held, by, min_pairs, threshold, recall, cap, waves, bits, sketch)
    left, right = by.select(F.col("h").alias("a"), F.col("rid").alias("x")), by.select(F.col("h").alias("b"), F.col("rid").alias("y"))
    wide = small(materialize(found, "pairs")).join(left, "a").join(right, "b").select("x", "y", (F.col("both") / F.col("either")).alias("similarity"))
    more = by.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h")
    equal = by.join(more, "h")
    same = equal.alias("p").join(equal.alias("q"), "h").filter("p.rid < q.rid").select(F.col("p.rid").alias("x"), F.col("q.rid").alias("y"), F.lit(1.0).alias("similarity"))
    return wide.union(same).select(F.least("x", "y").alias("rid_a"), F.greatest("x", "y").alias("rid_b"), "similarity")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, group (the least node of its connected component), by alternating large-star and small-star steps.

    Each step groups a node's neighbours only through their minimum, so no neighbourhood is collected; the edges are
    written after each round. The number of rounds grows with the logarithm of the largest component."""
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    previous = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        near = large.join(lowest, "u")
        star = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", F.col("m").alias("v")))
        e = materialize(star.filter("u <> v").distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == previous:
            break
        previous = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("group")).union(e.select("v", "v").distinct())


def near_groups(records: DataFrame, record_id: str = "case_key", turns: str = "turns", threshold: float = 0.6, min_pairs: int = 10, recall: float = 0.99, cap: int = 8, waves: int = 4, bits: int = 256, sketch: bool = True) -> DataFrame:
    """One row per record that is near another: record, group (the least record of the component), links (how many
    records it is near). Groups are made of sets, so copies are counted but never paired."""
    held = sets(records, record_id, turns)
    by = materialize(members(held, min_pairs, bits), "members")
    found = materialize(near_sets(held, by, min_pairs, threshold, recall, cap, waves, bits, sketch).select("a", "b"), "pairs")
    sizes = by.groupBy("h").agg(F.count("*").alias("n"), F.min("rid").alias("least"))
    beside = found.union(found.select("b", "a")).toDF("h", "other").join(sizes.select(F.col("h").alias("other"), "n"), "other").groupBy("h").agg(F.sum("n").alias("others"))
    known = sizes.join(beside, "h", "left").join(components(found).withColumnsRenamed({"node": "h", "group": "g"}), "h", "left")
    known = materialize(known.select("h", "least", F.coalesce("g", "h").alias("g"), (F.col("n") - 1 + F.coalesce("others", F.lit(0))).alias("links")).filter("links > 0"), "known")
    first = known.groupBy("g").agg(F.min("least").alias("group_key"))
    return by.select("h", "rid").join(known.join(first, "g").select("h", "group_key", "links"), "h").select(F.col("rid").alias(record_id), "group_key", "links")
