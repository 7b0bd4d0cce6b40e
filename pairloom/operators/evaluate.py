"""Crossing, pairing, reconciling and summing up of evaluations, all as DataFrames.

Input is one row per case x capability x model, or rows with both sides; no state is kept on the driver. Sums over
models, models x capabilities and models x categories come from one pass with grouping sets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import display_name, rule_result
from pairloom.functions.verdict import py_round
from pairloom.session import materialize, small


class Evaluator:
    """What scores answers: an expression of score, passed and reasons over columns of answers and of what is expected."""

    def evaluate(self, response: Column, expected: Column) -> Column:
        raise NotImplementedError(f"{type(self).__name__} scores nothing")


class Rules(Evaluator):
    """Exact match and, if keywords are given, their coverage."""

    def __init__(self, keywords: Column | None = None):
        self.keywords = keywords

    def evaluate(self, response: Column, expected: Column) -> Column:
        none = F.array().cast("array<string>")
        return rule_result(response, expected, none if self.keywords is None else self.keywords)


def grid(cases: DataFrame, capabilities: list[str], models: list[str] | None = None) -> DataFrame:
    """Every case with every capability and, if given, every model: the lists are literals, so nothing is joined."""
    out = cases.withColumn("capability", F.explode(F.array(*map(F.lit, capabilities))))
    if models:
        out = out.select("*", F.posexplode(F.array(*map(F.lit, models))).alias("slot", "model_name"))
    return out


def both_sides(long: DataFrame, keys: list[str], slot: str, value: Column) -> DataFrame:
    """One row per key from one row per slot (0 is A, 1 is B): a single shuffle, no self-join."""
    side = lambda k: F.max(F.when(F.col(slot) == k, value))
    return long.groupBy(*keys).agg(side(0).alias("a"), side(1).alias("b"))


def run_names(runs: DataFrame) -> DataFrame:
    """benchmark_id, model_a, model_b: the display names of each run's two models."""
    name = lambda k: display_name(*(F.get("models", F.lit(k))[c] for c in ("provider", "model", "alias")))
    return runs.select("benchmark_id", name(0).alias("model_a"), name(1).alias("model_b"))


def repeated(results: DataFrame) -> DataFrame:
    """The result_ids that were delivered more than once, written: only ids are moved to find them."""
    return materialize(results.groupBy("result_id").count().filter("count > 1 and result_id is not null").select("result_id"), "repeated")


def once(results: DataFrame, *columns: str, again: DataFrame | None = None) -> DataFrame:
    """Every result_id once, by its first delivery; one without a time comes after all that have one, and of deliveries at
    the same time the one whose columns have the least hash stands. Rows without an id are each a result. Only what was
    delivered more than once is moved; `again` are those deliveries, if known already."""
    if again is None:
        ids = small(repeated(results))
        again = results.join(ids, "result_id", "left_semi")
    else:
        ids = small(again.select("result_id"))
    single = results.join(ids, "result_id", "left_anti").select("result_id", *columns)
    arrival = F.struct(F.col("received_at").isNull(), F.col("received_at"), F.xxhash64(F.to_json(F.struct(*columns))))  # min_by passes over what is null itself
    more = again.groupBy("result_id").agg(F.min_by(F.struct(*columns), arrival).alias("r")).select("result_id", "r.*")
    return single.union(more)


def sided(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Results with model_a, model_b and the answers a and b; runs are broadcast if small by their file sizes."""
    joined = results.join(small(run_names(runs)), "benchmark_id")
    return joined.withColumn("a", F.col("responses")[F.col("model_a")]).withColumn("b", F.col("responses")[F.col("model_b")])


def outcomes(pairs: DataFrame, *keys: str) -> DataFrame:
    """keys, model_name, outcome (win, tie, loss), score: two rows for each judged pair (model_a, model_b, winner, score_a, score_b)."""
    side = lambda m, s, mine, other: F.struct(F.col(m).alias("model_name"), F.when(F.col("winner") == mine, "win").when(F.col("winner") == other, "loss").otherwise("tie").alias("outcome"), F.col(s).alias("score"))
    return pairs.filter("winner is not null").select(*keys, F.inline(F.array(side("model_a", "score_a", "A", "B"), side("model_b", "score_b", "B", "A"))))


def totals() -> list[Column]:
    count = lambda o: F.count_if(F.col("outcome") == o)
    return [count("win").alias("wins"), count("tie").alias("ties"), count("loss").alias("losses"), F.avg("score").alias("avg_score")]


def summary(pairs: DataFrame) -> DataFrame:
    """Rows of level model, capability or category: model_name, capability, category, wins, ties, losses, avg_score.

    One shuffle for all levels; the mean is over all scores of the group, so that of a model is not a mean of means.
    """
    long = outcomes(pairs, "capability", "category")
    sets = [[F.col("model_name")], [F.col("model_name"), F.col("capability")], [F.col("model_name"), F.col("category")]]
    level = F.when(F.grouping("capability") == 0, "capability").when(F.grouping("category") == 0, "category").otherwise("model").alias("level")
    return long.groupingSets(sets, "model_name", "capability", "category").agg(level, *totals()).select("level", "model_name", "capability", "category", "wins", "ties", "losses", "avg_score")


def with_zeros(sums: DataFrame, models: list[str]) -> DataFrame:
    """Model totals with a row of zeros for models without any pair."""
    spark = sums.sparkSession
    known = spark.createDataFrame([(i, m) for i, m in enumerate(models)], "slot int, model_name string")
    own = sums.filter("level = 'model'").drop("level", "capability", "category")
    return known.join(own, "model_name", "left").fillna(0, ["wins", "ties", "losses"]).fillna(0.0, ["avg_score"])


def overall(pairs: DataFrame, *keys: str) -> DataFrame:
    """Per key (or in all) the model with more wins, or tie; only wins count."""
    sums = pairs.filter("winner is not null").groupBy(*keys).agg(F.first("model_a").alias("model_a"), F.first("model_b").alias("model_b"), F.count_if(F.col("winner") == "A").alias("wins_a"), F.count_if(F.col("winner") == "B").alias("wins_b"), F.count_if(F.col("winner") == "tie").alias("ties"))
    return sums.withColumn("overall_winner", F.when(F.col("wins_a") > F.col("wins_b"), F.col("model_a")).when(F.col("wins_a") < F.col("wins_b"), F.col("model_b")).otherwise("tie"))


def first_items(cases: DataFrame, order: str, n: int | None) -> DataFrame:
    """The first n cases in order; 0 and None mean all."""
    return cases.orderBy(order).limit(n) if n else cases


def documents(pairs: DataFrame, runs: DataFrame) -> DataFrame:
    """Recorded runs in the shape of result documents (sources.files.RESULT_DOCUMENT): one row a run, with sums by model and by
    category, each from counts made before they are put together. `pairs` as in `summary`, with benchmark_id."""
    long = outcomes(pairs, "benchmark_id", "category")
    sums = long.groupingSets([[F.col("benchmark_id"), F.col("model_name")], [F.col("benchmark_id"), F.col("model_name"), F.col("category")]], "benchmark_id", "model_name", "category").agg(F.grouping("category").alias("all"), *totals())
    stat = F.struct(F.col("wins").alias("total_wins"), F.col("ties").alias("total_ties"), F.col("losses").alias("total_losses"), py_round(F.coalesce("avg_score", F.lit(0.0)), 2).alias("avg_score"))
    models = sums.filter("all = 1").groupBy("benchmark_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_name", stat)))).alias("models"))
    each = sums.filter("all = 0 and category is not null").groupBy("benchmark_id", "category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("model_name", F.struct("wins", "ties"))))).alias("m"))
    by_category = each.groupBy("benchmark_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", F.col("m"))), lambda x, y: F.when(x["category"] < y["category"], -1).otherwise(1))).alias("by_category"))
    won = overall(pairs, "benchmark_id").select("benchmark_id", "overall_winner")
    counted = pairs.groupBy("benchmark_id").agg(F.count("*").alias("total_test_cases"))
    facts = runs.select("benchmark_id", "benchmark_name", F.col("started_at").cast("string").alias("timestamp"), "duration_seconds", F.struct(F.col("domain_name").alias("domain"), "capabilities", F.transform("models", lambda m: F.struct(m["provider"].alias("provider"), m["model"].alias("model"), m["alias"].alias("alias"))).alias("models")).alias("config"))
    joined = facts.join(counted, "benchmark_id").join(won, "benchmark_id", "left").join(models, "benchmark_id", "left").join(by_category, "benchmark_id", "left")
    return joined.select("benchmark_id", "benchmark_name", "timestamp", "duration_seconds", "config", F.struct("total_test_cases", "overall_winner", "models", "by_category").alias("summary"))


def compare(documents: DataFrame) -> DataFrame:
    """One row per result document with at least two models: name, winner, wins of the first two, ties of the first."""
    name = lambda k: display_name(*(F.get("config.models", F.lit(k))[c] for c in ("provider", "model", "alias")))
    two = documents.filter(F.size("config.models") >= 2).withColumns({"m1": name(0), "m2": name(1)})
    stat = lambda m, s: F.coalesce(F.col("summary.models")[F.col(m)][s], F.lit(0))
    return two.select("file", "benchmark_name", F.col("summary.overall_winner").alias("winner"), F.col("m1").alias("model_1"), stat("m1", "total_wins").alias("wins_1"), F.col("m2").alias("model_2"), stat("m2", "total_wins").alias("wins_2"), stat("m1", "total_ties").alias("ties"))
