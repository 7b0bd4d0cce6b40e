"""Texts cut off by field limits: length hazards, tested with false-discovery control, and incomplete endings.

The hazard of a length is the number of texts of that length over the number of at least that length. A source that
cuts at a limit shows a hazard there far above its neighbours'. Lengths are counted in characters and in bytes, as a
limit may hold for either. For each source and measure, window functions give the texts at risk and the neighbours'
mean on either side; the larger is the expected count, and Chernoff's bound gives the chance of the count seen. Lengths
are significant by Benjamini and Hochberg's rule within the source.

An answer is cut by one of two routes, which `cuts` names:

limit     it has a significant length, and its ending is incomplete or a list item, after which more may have stood
transfer  it has another length, and its ending is incomplete: cut while it was sent, which leaves no mark in the lengths

Defined cases: null and empty texts, and those that say nothing (see `says_nothing`), are not truncated; a null source
is a source of its own; an answer delivered again counts once, by its first delivery, and of deliveries at the same time
by the text with the least hash; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.endings import INCOMPLETE, ITEM, LEAST_END, LEAST_NUMBER, LEAST_OPEN, LEAST_PAIR, NUMBER, PAIR_IN_LIST, WORD_IN_LIST, Endings, Tally, open_end
from pairloom.operators.evaluate import once, repeated
from pairloom.session import materialize, small

MARKUP = re.compile(r"<[^<>]*>|```\w*|&nbsp;|&#160;")
STAND_IN = re.compile(
    r"\W*(?:null|nil|nan|none|undefined|n\W?a|tbd|todo|(?:no|empty|missing|blank)[\s_-]+(?:content|response|answer|output|data|text|reply|message|result)(?:[\s_-]+(?:given|provided|available|returned))?"
    r"|(?:content|response|answer|output|text)[\s_-]+(?:missing|unavailable|not[\s_-]+available|empty|removed|omitted)|empty|placeholder|keine[\s_-]+(?:antwort|angabe)|sin[\s_-]+respuesta|(?:pas[\s_-]+de|aucune|sans)[\s_-]+réponse)\W*",
    re.IGNORECASE,
)
SHOWN = re.compile(r"[^\W_]|[\U0001F000-\U0001FAFF☀-➿]")

#: Counts that a task holds before it passes them on.
MOST_COUNTS = 1 << 18

LIMIT, TRANSFER = "limit", "transfer"

RESPONSES = "result_id bigint, received_at timestamp_ntz, responses map<string, struct<response: string>>"

#: Endings the classifier need not see: a final mark that no ellipsis, number or cut mark is part of.
PLAIN_END = r"""[^\d.…�][!?.]["'”’»)]*\s*$"""


def says_nothing(text: str | None) -> bool:
    """Null, nothing visible, mere marks or markup, or a stand-in for missing content."""
    if text is None:
        return True
    if len(text) > 100 and text[0].isalnum():  # longer than any stand-in, and it shows a letter or digit
        return False
    bare = MARKUP.sub(" ", text)
    return not SHOWN.search(bare) or bool(STAND_IN.fullmatch(bare))


def deliveries(results: DataFrame) -> DataFrame:
    """All deliveries of results that were delivered more than once, written."""
    return materialize(results.join(small(repeated(results)), "result_id", "left_semi"), "again")


def lengths(results: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """source, measure, length of every answer, once; only lengths are moved."""
    sized = F.transform_values("responses", lambda _, v: F.struct(F.length(v["response"]).alias("chars"), F.octet_length(v["response"]).alias("bytes")))
    each = once(results.withColumn("sized", sized), "sized", again=None if again is None else again.withColumn("sized", sized)).select(F.explode("sized").alias("source", "v"))
    pair = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(f"v.{m}").alias("length")) for m in ("chars", "bytes")))
    return each.select("source", F.inline(pair)).filter("length > 0")


def hazards(lengths: DataFrame, reach: int = 16, level: float = 0.001) -> DataFrame:
    """source, measure, length, n, at_risk, hazard, expected, log_p, significant."""
    counts = lengths.groupBy("source", "measure", "length").agg(F.count("*").alias("n"))
    one = Window.partitionBy("source", "measure").orderBy("length")
    below, above = (F.coalesce(F.sum("n").over(one.rangeBetween(*r)), F.lit(0)) / reach for r in ((-reach, -1), (1, reach)))
    at_risk = F.sum("n").over(Window.partitionBy("source", "measure").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0))
    tested = counts.select("*", at_risk.alias("at_risk"), F.greatest(below, above, F.lit(1.0 / reach)).alias("expected"))
    n, e = F.col("n"), F.col("expected")
    tested = tested.withColumn("hazard", n / F.col("at_risk")).withColumn("log_p", F.when(n > e, n - e - n * F.log(n / e)).otherwise(0.0))
    source = Window.partitionBy("source")
    ranked = tested.withColumn("k", F.row_number().over(source.orderBy("log_p", "measure", "length"))).withColumn("m", F.count("*").over(source))
    passed = F.when(F.col("log_p") <= F.log(F.col("k") * level / F.col("m")), F.col("k"))
    return ranked.withColumn("last", F.coalesce(F.max(passed).over(source), F.lit(0))).select("source", "measure", "length", "n", "at_risk", "hazard", "expected", "log_p", (F.col("k") <= F.col("last")).alias("significant"))


def limits(results: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """The significant lengths: source, measure, length."""
    return materialize(hazards(lengths(results, again)).filter("significant").select("source", "measure", "length"), "limits")


def answers(results: DataFrame, *columns: str) -> DataFrame:
    """One row per answer of every delivery: result_id, received_at, model_name, response and other columns."""
    return results.select("result_id", "received_at", *columns, F.explode("responses").alias("model_name", "a")).select("result_id", "received_at", *columns, "model_name", F.col("a.response").alias("response"))


def plain_end() -> Column:
    return F.substring(F.rtrim("response"), -24, 24).rlike(PLAIN_END)


def mark_limits(each: DataFrame, found: DataFrame) -> DataFrame:
    """Add at_limit: the answer has a significant length of its source, in characters or bytes."""
    for measure, size in (("chars", F.length("response")), ("bytes", F.octet_length("response"))):
        at = found.filter(F.col("measure") == measure).select(F.col("source").alias("s__"), F.col("length").alias("l__"), F.lit(True).alias(measure))
        each = each.join(small(at), F.col("model_name").eqNullSafe(F.col("s__")) & (size == F.col("l__")), "left").drop("s__", "l__")
    return each.withColumn("at_limit", F.coalesce("chars", "bytes", F.lit(False))).drop("chars", "bytes")


def fit_endings(results: DataFrame) -> Endings:
    """The classifier of endings, from all answers: a pass over those with an open end finds which of these recur, a second one
    over all answers counts what tells whole ends from cuts. Only counts are moved."""

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for batch in batches:
            found.update(s for t in batch.column(0).to_pylist() if not says_nothing(t) and (s := open_end(t)) is not None)
            if len(found) >= MOST_COUNTS:
                yield sums(found)
                found.clear()
        yield sums(found)

    def sums(found: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["what", "n"])

    each = answers(results).select("response").filter(F.col("response").isNotNull())
    recur = each.filter(~plain_end()).mapInArrow(ends, "what string, n bigint").groupBy("what").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_OPEN)
    open_ends = Endings.asked({r.what: r.n for r in recur.collect()})
    sent = results.sparkSession.sparkContext.broadcast(list(open_ends))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(sent.value)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not says_nothing(t):
                    tally.add(t)
            if len(tally.n) >= MOST_COUNTS:
                yield counts(tally)
                tally.n.clear()
                tally.ends.clear()
        yield counts(tally)

    def counts(tally: Tally) -> pa.RecordBatch:
        columns = ([k for k, _ in tally.n], pa.int32()), ([w for _, w in tally.n], pa.string()), (list(tally.n.values()), pa.int64()), ([tally.ends[k] for k in tally.n], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], ["kind", "what", "n", "ends"])

    summed = each.mapInArrow(count, "kind int, what string, n bigint, ends bigint").groupBy("kind", "what").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    telling = F.when(F.col("kind") == WORD_IN_LIST, F.col("ends") >= LEAST_END).when(F.col("kind") == PAIR_IN_LIST, F.col("n") >= LEAST_PAIR).when(F.col("kind") == NUMBER, F.col("n") >= LEAST_NUMBER).otherwise(True)
    return Endings.of(open_ends, (tuple(r) for r in summed.filter(telling).collect()))


def first_only(rows: DataFrame, again: DataFrame) -> DataFrame:
    """Of rows (result_id, received_at, model_name, text_hash) those of an answer's first delivery; `again` has the deliveries of
    results that were delivered more than once."""
    each = again.select("result_id", "received_at", F.explode("responses").alias("model_name", "a"))
    first = each.groupBy("result_id", "model_name").agg(F.min(F.struct(F.col("received_at").isNull(), F.col("received_at"), F.xxhash64("a.response"))).alias("first__"))
    known = rows.join(small(first), ["result_id", "model_name"], "left")
    own = F.struct(F.col("received_at").isNull(), F.col("received_at"), F.col("text_hash"))
    return known.filter(F.col("first__").isNull() | own.eqNullSafe(F.col("first__"))).select(rows.columns)


def cuts(results: DataFrame, again: DataFrame | None = None) -> DataFrame:
    """result_id, model_name, route of every truncated answer."""
    again = deliveries(results) if again is None else again
    sent = results.sparkSession.sparkContext.broadcast(fit_endings(results))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = sent.value
        for batch in batches:
            routes = []
            for text, at_limit in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                state = endings.state(text)
                cut = (state == INCOMPLETE or (state == ITEM and at_limit)) and not says_nothing(text)
                routes.append((LIMIT if at_limit else TRANSFER) if cut else None)
            route = pa.array(routes, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], route], ["result_id", "received_at", "model_name", "text_hash", "route"]).filter(route.is_valid())

    open_ended = answers(results).filter(F.col("response").isNotNull() & ~plain_end())
    marked = mark_limits(open_ended, limits(results, again)).select("result_id", "received_at", "model_name", F.xxhash64("response").alias("text_hash"), "response", "at_limit")
    found = materialize(marked.mapInArrow(judge, "result_id bigint, received_at timestamp_ntz, model_name string, text_hash bigint, route string"), "cut")
    return first_only(found, again).select("result_id", "model_name", "route").distinct()


def truncated(results: DataFrame) -> DataFrame:
    """result_id, model_name of every truncated answer."""
    return cuts(results).select("result_id", "model_name")


def report(results: DataFrame) -> DataFrame:
    """Per model: answers, truncated answers, how many of them by a limit and in transfer, and their share."""
    again = deliveries(results)
    names = once(results.withColumn("names", F.map_keys("responses")), "names", again=again.withColumn("names", F.map_keys("responses")))  # the texts stay where they are
    total = names.select(F.explode("names").alias("model_name")).groupBy("model_name").agg(F.count("*").alias("n_answers"))
    by = lambda r: F.count_if(F.col("route") == r)
    cut = cuts(results, again=again).groupBy("model_name").agg(F.count("*").alias("n_truncated"), by(LIMIT).alias("n_limit"), by(TRANSFER).alias("n_transfer"))
    joined = total.join(cut, "model_name", "left").fillna(0, ["n_truncated", "n_limit", "n_transfer"])
    return joined.withColumn("share", F.round(F.col("n_truncated") / F.col("n_answers"), 6))
