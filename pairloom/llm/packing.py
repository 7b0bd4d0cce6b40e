"""Filling containers of fixed capacity with texts: mixture-controlled packing.

Sizes are tokens of a public tokenizer. Each source is a queue, in the order of a hash of the document id. Deficit
round-robin serves the queues in rounds, one round for each window of `containers` containers: a queue earns its share
of the window's tokens as credit, sends items while its credit covers them and carries what is left to the next round.
With queues that are never idle this has a closed form: an item whose end lies at `c` tokens in its queue goes in round
ceil(c / quantum) - 1. So rounds come from running sums, which are taken by blocks of the sorted queue and chained by
the sums of the blocks before: deficits carry across windows and partitions alike, and no queue meets in one task.

A window holds about its capacity, plus at most one item a queue, and is packed alone by best fit, longest first. An
item longer than a container is cut into whole containers and a rest; no other item is divided.

Shares are those of the sources' tokens, or `targets` for the sources named there. Containers are numbered from 0
without gaps. Defined cases: null and empty texts have no tokens, take no space and are given container 0; a null
source is a queue of its own; equal texts are packed each; an empty table gives no rows. Ids must be unique.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.session import materialize, small

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
_loaded: dict[str, object] = {}


def public_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoding(path: str, pattern: str | None = None):
    """The tokenizer of a rank file, kept for the life of the worker."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding("own", pat_str=pattern or public_pattern(), mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def sizes(docs: DataFrame, doc_id: str, text: str, source: str, tokenizer: str, pattern: str | None = None) -> DataFrame:
    """doc, queue, n: tokens of each text. The rank file is a file of the driver that Spark sends to the workers."""
    pattern = pattern or public_pattern()
    docs.sparkSession.sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(SparkFiles.get(name), pattern)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["doc", "queue", "n"])

    held = docs.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(source).cast("string").alias("queue"), F.col(text).alias("text"))
    return held.mapInArrow(count, "doc bigint, queue string, n bigint")


def running(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Inclusive running sums of `value` per key, by blocks of the sorted rows; keys may be null or hold most rows."""
    blocks = materialize(df.repartitionByRange(*keys, *order).withColumn("block__", F.spark_partition_id()), "blocks")
    sums = blocks.groupBy("block__", *keys).agg(F.sum(value).alias("sum__"))
    before = Window.partitionBy(*keys).orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)
    starts = small(materialize(sums.withColumn("start__", F.coalesce(F.sum("sum__").over(before), F.lit(0))).drop("sum__"), "starts"))
    inside = Window.partitionBy("block__", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.withColumn(out, F.sum(value).over(inside)).alias("x")
    same = F.col("x.block__") == F.col("y.block__")
    for k in keys:
        same &= F.col(f"x.{k}").eqNullSafe(F.col(f"y.{k}"))
    return local.join(starts.alias("y"), same).select(*(F.col(f"x.{c}") for c in df.columns), (F.col(f"x.{out}") + F.col("y.start__")).alias(out))


def shares(sized: DataFrame, targets: dict[str, float] | None) -> DataFrame:
    """queue, share: of the tokens, or as asked for. The sums over all queues are three numbers."""
    totals = materialize(sized.groupBy("queue").agg(F.sum("n").alias("m")), "totals")
    asked: Column = F.lit(None).cast("double")
    for name, share in (targets or {}).items():
        asked = F.when(F.col("queue").eqNullSafe(F.lit(name)), F.lit(float(share))).otherwise(asked)
    of = totals.select("queue", "m", asked.alias("asked")).agg(F.sum("m").alias("all"), F.sum("asked").alias("asked"), F.sum(F.when(F.col("asked").isNull(), F.col("m"))).alias("rest")).first()
    total = max(1, of["all"] or 0)
    weight = (of["asked"] or 0.0) + (of["rest"] or 0) / total
    return totals.select("queue", (F.coalesce(asked, F.col("m") / total) / (weight or 1.0)).alias("share"))


def best_fit(items: list[tuple[int, int]], capacity: int) -> dict[int, int]:
    """item -> container, longest first into the fullest container that has room; (item, size) of 1 to capacity."""
    free: dict[int, list[int]] = {}
    mask, used, out = 0, 0, {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        fits = mask >> size
        if fits:
            room = size + ((fits & -fits).bit_length() - 1)
            box = free[room].pop()
            if not free[room]:
                mask &= ~(1 << room)
        else:
            room, box = capacity, used
            used += 1
        out[item] = box
        left = room - size
        if left:
            free.setdefault(left, []).append(box)
            mask |= 1 << left
    return out


def rounds(sized: DataFrame, capacity: int, containers: int, targets: dict[str, float] | None) -> DataFrame:
    """doc, queue, n, round of every text with tokens."""
    held = sized.filter("n > 0").withColumn("place", F.xxhash64("doc"))
    ends = running(held, ["queue"], ["place", "doc"], "n", "upto")
    quanta = small(materialize(shares(sized, targets), "shares")).alias("q")
    quantum = F.col("q.share") * capacity * containers
    joined = ends.alias("x").join(quanta, F.col("x.queue").eqNullSafe(F.col("q.queue")))
    return joined.select("x.doc", "x.queue", "x.n", (F.ceil(F.col("x.upto") / quantum) - 1).cast("bigint").alias("round"))


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = 2048, containers: int = 256, tokenizer: str = TOKENIZER, pattern: str | None = None, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, source, piece, first_token, n_tokens, container; one row per text, or per piece of a text that exceeds a container."""
    sized = materialize(sizes(docs, doc_id, text, source, tokenizer, pattern), "sizes")
    served = rounds(sized, capacity, containers, targets)

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(d, q, k, k * capacity, min(capacity, n - k * capacity)) for d, q, n in zip(pdf["doc"], pdf["queue"], pdf["n"]) for k in range(-(-n // capacity))]
        rows.sort(key=lambda r: (r[0], r[2]))
        box = best_fit([(i, r[4]) for i, r in enumerate(rows)], capacity)
        return pd.DataFrame([(key[0], *r, box[i]) for i, r in enumerate(rows)], columns=["round", "doc", "queue", "piece", "first", "n", "box"])

    shape = "round bigint, doc bigint, queue string, piece bigint, first bigint, n bigint, box bigint"
    packed = materialize(served.groupBy("round").applyInPandas(fill, shape), "packed")
    counts = packed.groupBy("round").agg((F.max("box") + 1).alias("boxes")).withColumn("all__", F.lit(0))
    offsets = running(counts, ["all__"], ["round"], "boxes", "upto").select("round", (F.col("upto") - F.col("boxes")).alias("start"))
    numbered = packed.join(offsets, "round").select(F.col("doc").alias("doc_id"), F.col("queue").alias("source"), "piece", F.col("first").alias("first_token"), F.col("n").alias("n_tokens"), (F.col("start") + F.col("box")).alias("container"))
    nothing = [F.lit(0).cast("bigint").alias(c) for c in ("piece", "first_token", "n_tokens", "container")]
    return numbered.union(sized.filter("n = 0").select(F.col("doc").alias("doc_id"), F.col("queue").alias("source"), *nothing))


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, share of the space filled, the least number of containers possible, fullest and emptiest."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    total = F.sum("n")
    return each.agg(F.count("*").alias("n_containers"), total.alias("n_tokens"), F.round(total / (F.count("*") * capacity), 6).alias("filled"), F.ceil(total / capacity).alias("least_containers"), F.max("n").alias("fullest"), F.min("n").alias("emptiest"))


def mixture(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", capacity: int = 2048, containers: int = 256, tokenizer: str = TOKENIZER, pattern: str | None = None, targets: dict[str, float] | None = None) -> DataFrame:
    """Per window and source: tokens sent, tokens earned, and the deficit carried on (earned less sent so far)."""
    sized = materialize(sizes(docs, doc_id, text, source, tokenizer, pattern), "sizes")
    served = rounds(sized, capacity, containers, targets).groupBy("queue", "round").agg(F.sum("n").alias("sent"))
    quanta = small(materialize(shares(sized, targets), "shares")).alias("q")
    sofar = F.sum("sent").over(Window.partitionBy("x.queue").orderBy("round").rowsBetween(Window.unboundedPreceding, 0))
    earned = F.col("share") * capacity * containers
    joined = served.alias("x").join(quanta, F.col("x.queue").eqNullSafe(F.col("q.queue")))
    return joined.select(F.col("x.queue").alias("source"), "round", "sent", F.round(earned, 3).alias("earned"), F.round((F.col("round") + 1) * earned - sofar, 3).alias("deficit"))
