"""One global ranking from pairwise comparisons: spring energy ranking (De Bacco, Larremore and Moore 2018).

Each comparison is a spring that wants its winner one unit above its loser. The strengths s minimise
1/2 sum_ij w_ij (s_i - s_j - 1)^2 + alpha/2 sum_i s_i^2, where w_ij counts the wins of i over j and a tie counts half a
win either way. That is one sparse positive definite system, (D + alpha I - W) s = d_out - d_in with W = w + w', D its
row sums, solved by conjugate gradients with the Jacobi preconditioner D + alpha I. The matrix is a DataFrame of pairs
that met, aggregated before any join; vectors are a DataFrame by item. An iteration is one job: a join on the
neighbour, a sum by item and a write to the shared folder, which also observes the three sums the next step needs.
alpha ties components that never met to a common zero, so one ranking covers all items.

Defined cases: null winners, items or self-comparisons are left out; items without comparisons (from `items`) have
strength 0; ties in strength share a rank; no comparisons at all give every item strength 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.operators.evaluate import once
from pairloom.session import materialize, small


def strengths(wins: DataFrame, alpha: float = 0.1, tolerance: float = 1e-12, rounds: int = 500, restarts: int = 20) -> DataFrame:
    """item, strength of every item in `wins` (i, j, w).

    The sums of a step give the next residual's norm by a difference, which is exact to about eight digits of a drop; so
    the residual is computed afresh after each such drop, and the solution stands when that one is small enough."""
    both = wins.select("i", "j", "w", F.col("w").alias("b")).union(wins.select("j", "i", "w", -F.col("w")))
    matrix = materialize(both.groupBy("i", "j").agg(F.sum("w").alias("w"), F.sum("b").alias("b")), "springs")
    edges = matrix.select("i", "j", "w")
    fixed = materialize(matrix.groupBy("i").agg((F.sum("w") + alpha).alias("d"), F.sum("b").alias("b")), "fixed")
    solution = fixed.select("i", F.lit(0.0).alias("s"))
    q, r, d, p = (F.col(c) for c in "qrdp")

    def pulled(vector: DataFrame, column: str) -> DataFrame:
        return edges.join(vector.select(F.col("i").alias("j"), F.col(column).alias("x")), "j").groupBy("i").agg(F.sum(F.col("w") * F.col("x")).alias("wx"))

    first = None
    for _ in range(restarts):
        seen = Observation()
        state = fixed.join(solution, "i").join(pulled(solution, "s"), "i").select("i", "d", "s", (F.col("b") - d * F.col("s") + F.col("wx")).alias("r"))
        state = materialize(state.select("*", (r / d).alias("p")).observe(seen, F.sum(r * r / d).alias("rz")), "state")
        rz = begun = seen.get["rz"] or 0.0
        first = rz if first is None else first
        if rz <= tolerance * tolerance * first:
            return state.select(F.col("i").alias("item"), F.col("s").alias("strength"))
        while rz > max(1e-8 * begun, tolerance * tolerance * first) and rounds:
            rounds -= 1
            seen = Observation()
            step = state.join(pulled(state, "p"), "i").withColumn("q", d * p - F.col("wx")).drop("wx")
            step = materialize(step.observe(seen, F.sum(p * q).alias("pq"), F.sum(r * q / d).alias("rq"), F.sum(q * q / d).alias("qq")), "state")
            sums = seen.get
            a = rz / sums["pq"]
            now = max(0.0, rz - 2 * a * sums["rq"] + a * a * sums["qq"])
            state = step.select("i", "d", (F.col("s") + a * p).alias("s"), (r - a * q).alias("r"), ((r - a * q) / d + now / rz * p).alias("p"))
            rz = now
        solution = state.select("i", "s")
    raise RuntimeError("no solution within the rounds allowed")


def ranking(matches: DataFrame, items: DataFrame | None = None, alpha: float = 0.1) -> DataFrame:
    """item, strength, rank, wins, losses, ties, of all items in matches or `items` (a column item)."""
    met = matches.filter(F.col("item_a").isNotNull() & F.col("item_b").isNotNull() & (F.col("item_a") != F.col("item_b")) & F.col("winner").isin("A", "B", "tie"))
    sums = materialize(met.groupBy("item_a", "item_b", "winner").agg(F.count("*").alias("n")), "met")
    solved = strengths(weighted(sums), alpha)
    sides = sums.select(F.col("item_a").alias("item"), F.lit("A").alias("side"), "winner", "n").union(sums.select("item_b", F.lit("B"), "winner", "n"))
    each = sides.groupBy("item").agg(
        F.sum(F.when(F.col("winner") == F.col("side"), F.col("n")).otherwise(0)).alias("wins"),
        F.sum(F.when(F.col("winner").isin("A", "B") & (F.col("winner") != F.col("side")), F.col("n")).otherwise(0)).alias("losses"),
        F.sum(F.when(F.col("winner") == "tie", F.col("n")).otherwise(0)).alias("ties"),
    )
    out = each.join(solved, "item", "left")
    if items is not None:
        out = items.select("item").filter("item is not null").distinct().join(out, "item", "full")
    out = out.fillna(0, ["wins", "losses", "ties"]).fillna(0.0, ["strength"]).withColumn("strength", F.round("strength", 6) + F.lit(0.0))
    return ranked(out)


def weighted(sums: DataFrame) -> DataFrame:
    """i, j, w from counts of (item_a, item_b, winner, n)."""
    n = F.col("n") * F.when(F.col("winner") == "tie", 0.5).otherwise(1.0)
    over = sums.filter("winner <> 'B'").select(F.col("item_a").alias("i"), F.col("item_b").alias("j"), n.alias("w"))
    under = sums.filter("winner <> 'A'").select(F.col("item_b").alias("i"), F.col("item_a").alias("j"), n.alias("w"))
    return over.union(under).groupBy("i", "j").agg(F.sum("w").alias("w"))


def ranked(strengths: DataFrame) -> DataFrame:
    """Ranks from counts per distinct strength, in blocks of the sorted order, so that no task holds all items."""
    levels = strengths.groupBy("strength").agg(F.count("*").alias("n"))
    blocks = materialize(levels.repartitionByRange(F.desc("strength")).withColumn("block", F.spark_partition_id()), "levels")
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    offsets = small(materialize(blocks.groupBy("block").agg(F.sum("n").alias("m")).select("block", F.coalesce(F.sum("m").over(upto), F.lit(0)).alias("before")), "offsets"))
    inside = Window.partitionBy("block").orderBy(F.desc("strength")).rowsBetween(Window.unboundedPreceding, -1)
    ranks = blocks.withColumn("above", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(offsets, "block").select("strength", (F.col("before") + F.col("above") + 1).alias("rank"))
    return strengths.join(ranks, "strength").select("item", "strength", "rank", "wins", "losses", "ties")


VERDICTS = "result_id bigint, benchmark_id string, received_at timestamp_ntz, winner string"


def display_name(model: str) -> F.Column:
    return F.coalesce(F.nullif(F.col(f"{model}.alias"), F.lit("")), F.concat_ws("/", f"{model}.provider", f"{model}.model"))


def matches(results: DataFrame, runs: DataFrame) -> DataFrame:
    """item_a, item_b, winner of each result, every result_id once."""
    first = once(results, "benchmark_id", "winner")
    pair = runs.select("benchmark_id", F.get("models", F.lit(0)).alias("a"), F.get("models", F.lit(1)).alias("b"))
    names = small(pair.select("benchmark_id", display_name("a").alias("item_a"), display_name("b").alias("item_b")))
    return first.filter("winner is not null").join(names, "benchmark_id").select("item_a", "item_b", "winner")
