"""Ranking entrants of a shared battery: cell means, complete tasks, intervals over tasks, paired cost.

A draw of tasks is the same for all entrants. Draws come from a hash of seed, draw and place, so any engine can repeat them and
no task's order matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from simlattice.functions.text import wilson


def of_model(results: DataFrame, model: str, legacy: str) -> DataFrame:
    """Results for one model; rows from before the model was recorded count as legacy's."""
    return results.filter(F.coalesce("requested_model", F.lit(legacy)) == model)


def cells(results: DataFrame) -> DataFrame:
    """(agent_id, task_id, passed, cost): means over replicates, a missing cost as 0."""
    return results.groupBy("agent_id", "task_id").agg(F.avg(F.col("passed").cast("double")).alias("passed"), F.avg(F.coalesce(F.col("cost_usd").cast("double"), F.lit(0.0))).alias("cost"))


def complete(cell: DataFrame) -> DataFrame:
    """The cells of tasks that every agent has a score for."""
    agents = cell.agg(F.count_distinct("agent_id").alias("_n"))
    full = cell.groupBy("task_id").agg(F.count_distinct("agent_id").alias("_k")).join(agents, F.col("_k") == F.col("_n")).select("task_id")  # one row of totals
    return cell.join(full, "task_id")


def draw(seed: int, boot: Column, place: Column, n: Column) -> Column:
    """A task number below n for a place of a draw: 28 bits of an MD5, modulo n."""
    text = F.concat_ws(":", F.lit(seed), boot, place)
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") % n


def draws(cell: DataFrame, boots: int, seed: int = 0) -> DataFrame:
    """(boot, task_id, times): how often each draw takes each task. Tasks are numbered by id; a battery is small."""
    tasks = cell.select("task_id").distinct().withColumn("_no", F.row_number().over(Window.orderBy("task_id")) - 1)
    n = tasks.agg(F.count("*").alias("_n"))
    spots = cell.sparkSession.range(boots).select(F.col("id").alias("boot")).join(n, F.lit(True))  # one row of totals
    spots = spots.filter("_n > 0").withColumn("_place", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    drawn = spots.select("boot", draw(seed, F.col("boot"), F.col("_place"), F.col("_n")).alias("_no"))
    return drawn.groupBy("boot", "_no").agg(F.count("*").alias("times")).join(tasks, "_no").select("boot", "task_id", "times")


def bootstrap(cell: DataFrame, boots: int = 2000, seed: int = 0) -> DataFrame:
    """(agent_id, pass_low, pass_high, cost_low, cost_high, rank_low, rank_high): 95% intervals over draws of tasks. In each draw, equal
    agents share the best rank."""
    drawn = draws(cell, boots, seed)
    means = cell.join(drawn, "task_id").groupBy("boot", "agent_id").agg((F.sum(F.col("passed") * F.col("times")) / F.sum("times")).alias("p"), (F.sum(F.col("cost") * F.col("times")) / F.sum("times")).alias("c"))
    ranked = means.withColumn("r", F.rank().over(Window.partitionBy("boot").orderBy(F.desc(F.round("p", 9)))))
    ends = F.array(F.lit(0.025), F.lit(0.975))
    out = ranked.groupBy("agent_id").agg(F.percentile("p", ends).alias("p"), F.percentile("c", ends).alias("c"), F.percentile("r", ends).alias("r"))
    end = lambda c, k: F.element_at(c, k)
    return out.select("agent_id", end("p", 1).alias("pass_low"), end("p", 2).alias("pass_high"), end("c", 1).alias("cost_low"), end("c", 2).alias("cost_high"), F.floor(end("r", 1)).alias("rank_low"), F.floor(end("r", 2)).alias("rank_high"))


def ranking(results: DataFrame) -> DataFrame:
    """(agent_id, pass_rate, mean_cost, passes, runs, wilson_low, wilson_high), best first.

    Rates are means over complete tasks; passes, runs and the Wilson interval are over all runs."""
    own = complete(cells(results)).groupBy("agent_id").agg(F.avg("passed").alias("pass_rate"), F.avg("cost").alias("mean_cost"))
    runs = results.groupBy("agent_id").agg(F.sum(F.col("passed").cast("long")).alias("passes"), F.count("*").alias("runs"))
    w = wilson(F.col("passes"), F.col("runs"))
    return own.join(runs, "agent_id", "right").withColumn("_w", w).select("agent_id", "pass_rate", "mean_cost", "passes", "runs", F.col("_w.low").alias("wilson_low"), F.col("_w.high").alias("wilson_high")).orderBy(F.desc("pass_rate"), "agent_id")


def by_capability(results: DataFrame) -> DataFrame:
    """(agent_id, capability, pass_rate) over complete tasks; a task's capability is the greatest that its rows name."""
    kinds = results.groupBy("task_id").agg(F.max("capability").alias("capability"))
    return complete(cells(results)).join(kinds, "task_id").groupBy("agent_id", "capability").agg(F.avg("passed").alias("pass_rate"))


def difficulty(results: DataFrame) -> DataFrame:
    """(task_id, pass_rate): the mean over agents of each complete task."""
    return complete(cells(results)).groupBy("task_id").agg(F.avg("passed").alias("pass_rate"))


def paired_cost(results: DataFrame, control: str, boots: int = 2000, seed: int = 0) -> DataFrame:
    """(agent_id, extra_cost, low, high), least first: total cost over the control's, less 1, on the control's tasks.

    Agents without one of these tasks are left out. Draws take tasks for both totals together."""
    cell = cells(results)
    base = cell.filter(F.col("agent_id") == control).select("task_id", F.col("cost").alias("base"))
    need = base.agg(F.count("*").alias("_need"))
    rows = cell.filter(F.col("agent_id") != control).join(base, "task_id")
    able = rows.groupBy("agent_id").agg(F.count("*").alias("_k")).join(need, F.col("_k") == F.col("_need")).select("agent_id")  # one row of totals
    rows = rows.join(able, "agent_id")
    point = rows.groupBy("agent_id").agg((F.sum("cost") / F.sum("base") - 1).alias("extra_cost"))
    drawn = draws(base, boots, seed)
    boot = rows.join(drawn, "task_id").groupBy("agent_id", "boot").agg((F.sum(F.col("cost") * F.col("times")) / F.sum(F.col("base") * F.col("times")) - 1).alias("x"))
    ends = boot.groupBy("agent_id").agg(F.percentile("x", F.array(F.lit(0.025), F.lit(0.975))).alias("e"))
    return point.join(ends, "agent_id").select("agent_id", "extra_cost", F.element_at("e", 1).alias("low"), F.element_at("e", 2).alias("high")).orderBy("extra_cost", "agent_id")


def job_grid(agents: DataFrame, tasks: DataFrame, reps: int, done: DataFrame, limit: int | None = None) -> DataFrame:
    """(rep, task_id, agent_id) of runs that are not done, in this order; a plan's grid is its result, and small."""
    grid = agents.select("agent_id").join(tasks.select("task_id"), F.lit(True)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    left = grid.join(done.select("rep", "task_id", "agent_id"), ["rep", "task_id", "agent_id"], "left_anti").orderBy("rep", "task_id", "agent_id")
    return left.limit(limit) if limit is not None else left


def run_status(results: DataFrame, queued: int) -> DataFrame:
    """One row: queued, done, passed, failed, cost."""
    return results.agg(F.lit(queued).alias("queued"), F.count("*").alias("done"), F.count_if("passed").alias("passed"), F.count_if(~F.coalesce(F.col("passed"), F.lit(False))).alias("failed"), F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost"))


def task_tally(tasks: DataFrame) -> DataFrame:
    """(type, total, valid, invalid) of validated tasks."""
    return tasks.groupBy("type").agg(F.count("*").alias("total"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))


def claim_bridge(claims: DataFrame) -> DataFrame:
    """(agent_id, capability_id) from claims(agent_id, capability_ids array)."""
    return claims.select("agent_id", F.explode("capability_ids").alias("capability_id")).distinct()


def coverage(bridge: DataFrame) -> DataFrame:
    """(capability_id, agents)."""
    return bridge.groupBy("capability_id").agg(F.count_distinct("agent_id").alias("agents"))
