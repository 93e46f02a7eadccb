"""What entities do with the same probes: distances of content, disposition and structure, and how far they follow other distances.

A missing answer is a missing row, and means are over what is there.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simlattice.functions.text import unit
from simlattice.operators.ranks import sum_before
from simlattice.schema import CAUGHT, JUDGE_FIELDS


def mean_vectors(answers: DataFrame) -> DataFrame:
    """(agent, probe, v): the mean over replicates of answers(agent, probe, rep, v), at length 1."""
    means = answers.select("agent", "probe", F.posexplode("v").alias("k", "x")).groupBy("agent", "probe", "k").agg(F.avg("x").alias("x"))
    whole = means.groupBy("agent", "probe").agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("a"))
    return whole.select("agent", "probe", unit(F.transform("a", lambda p: p["x"])).alias("v")).filter(F.col("v").isNotNull())


def _dot(u: str, v: str) -> Column:
    return F.aggregate(F.zip_with(u, v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def content_distances(answers: DataFrame) -> DataFrame:
    """(i, j, d), i < j: 1 - cosine of the mean answers to a probe, its mean over the probes that both have."""
    m = mean_vectors(answers)
    a, b = m.select("probe", F.col("agent").alias("i"), F.col("v").alias("u")), m.select("probe", F.col("agent").alias("j"), "v")
    return a.join(b, "probe").filter("i < j").groupBy("i", "j").agg(F.avg(1 - _dot("u", "v")).alias("d"))


def noise_ceiling(answers: DataFrame) -> DataFrame:
    """One row: the mean distance of the first two replicates of one agent and probe; null if there are none."""
    first = answers.filter("rep = 0").select("agent", "probe", F.col("v").alias("u"))
    second = answers.filter("rep = 1").select("agent", "probe", "v")
    return first.join(second, ["agent", "probe"]).agg(F.avg(1 - _dot("u", "v")).alias("noise"))


def judged(judgments: DataFrame, text: str = "text") -> DataFrame:
    """Judgments with disposition array<double> of JUDGE_FIELDS and caught (null for n/a), from the judge's JSON."""
    schema = ", ".join(f"{f} boolean" for f in JUDGE_FIELDS) + ", caught_planted_issue string, approach string"
    given = F.from_json(text, schema)
    caught = F.create_map(*[F.lit(x) for pair in CAUGHT.items() for x in pair])
    return judgments.withColumn("_j", given).withColumn("disposition", F.array(*[F.col(f"_j.{f}").cast("double") for f in JUDGE_FIELDS])).withColumn("caught", F.try_element_at(caught, F.coalesce("_j.caught_planted_issue", F.lit("n/a")))).drop("_j")


def profiles(rows: DataFrame, values: str, agent: str = "agent") -> DataFrame:
    """(agent, k, x): the mean of each field over an agent's rows; null fields do not count."""
    return rows.select(F.col(agent).alias("agent"), F.posexplode(values).alias("k", "x")).filter(F.col("x").isNotNull()).groupBy("agent", "k").agg(F.avg("x").alias("x"))


def _pairs(profile: DataFrame, of: Column) -> DataFrame:
    a, b = profile.select("k", F.col("agent").alias("i"), F.col("x").alias("xi")), profile.select("k", F.col("agent").alias("j"), F.col("x").alias("xj"))
    return a.join(b, "k").filter("i < j").groupBy("i", "j").agg(of.alias("d"))


def disposition_distances(rows: DataFrame, values: str = "disposition", agent: str = "agent") -> DataFrame:
    """(i, j, d): the mean absolute difference of mean judge answers."""
    return _pairs(profiles(rows, values, agent), F.avg(F.abs(F.col("xi") - F.col("xj"))))


def structure_distances(rows: DataFrame, values: str = "style", agent: str = "agent") -> DataFrame:
    """(i, j, d): the Euclidean distance of mean style features, each scaled by mean and population deviation over all agents."""
    p = profiles(rows, values, agent)
    scale = p.groupBy("k").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    z = p.join(scale, "k").select("agent", "k", ((F.col("x") - F.col("m")) / (F.col("s") + 1e-9)).alias("x"))
    return _pairs(z, F.sqrt(F.sum((F.col("xi") - F.col("xj")) ** 2)))


def agent_summary(answers: DataFrame, distances: DataFrame, baseline: str) -> DataFrame:
    """(agent, n, truncated, tokens_in, tokens_out, caught_rate, from_baseline) of every agent but the baseline.

    answers(agent, caught, stop_reason, usage); caught is null where there was nothing to catch."""
    own = answers.groupBy("agent").agg(
        F.count("*").alias("n"), F.count_if(F.col("stop_reason") == "max_tokens").alias("truncated"), F.sum(F.coalesce("usage.input", F.lit(0))).alias("tokens_in"), F.sum(F.coalesce("usage.output", F.lit(0))).alias("tokens_out"), F.avg("caught").alias("caught_rate")
    )
    either = distances.select(F.col("i").alias("agent"), F.col("j").alias("other"), "d").unionByName(distances.select(F.col("j").alias("agent"), F.col("i").alias("other"), "d"))
    far = either.filter(F.col("other") == baseline).select("agent", F.col("d").alias("from_baseline"))
    return own.filter(F.col("agent") != baseline).join(far, "agent", "left")


def pair_mean(pairs: DataFrame, distances: DataFrame, group: str = "stratum") -> DataFrame:
    """(stratum, n, mean): the mean distance over listed pairs(stratum, i, j), either way round."""
    listed = pairs.select(group, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return listed.join(distances, ["i", "j"]).groupBy(group).agg(F.count("*").alias("n"), F.avg("d").alias("mean"))


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Ranks from 1, ties by their mean, from counts by value."""
    n = rows.groupBy(value).agg(F.count("*").alias("_n"))
    place = sum_before(n, value, "_n", "_before").withColumn(name, F.col("_before") + (F.col("_n") + 1) / 2).drop("_n", "_before")
    return rows.join(place, value)


def spearman(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row, r: the correlation of ranks of two distances over the same pairs."""
    ranked = average_ranks(average_ranks(pairs, a, "_ra"), b, "_rb")
    return ranked.agg(F.corr("_ra", "_rb").alias("r"))


def _ranks(x: np.ndarray) -> np.ndarray:
    _, at, n = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(n) - (n - 1) / 2)[at]


def mantel(pairs: DataFrame, a: str = "a", b: str = "b", permutations: int = 999, seed: int = 0, most: int = 3000) -> DataFrame:
    """One row (r, p, n): the rank correlation of two distance matrices and how often a joint permutation of one reaches it.

    pairs(i, j, a, b) has every pair once. Matrices of up to `most` records go to each task, permutations are spread over tasks; more
    records are refused, as a dense matrix grows with their square."""
    spark = pairs.sparkSession
    ids = sorted(r[0] for r in pairs.select("i").union(pairs.select("j")).distinct().limit(most + 1).collect())
    if len(ids) > most:
        raise ValueError(f"a permutation test of more than {most} records is refused")
    at = {x: k for k, x in enumerate(ids)}
    n = len(ids)
    ma, mb = np.zeros((n, n)), np.zeros((n, n))
    for r in pairs.select("i", "j", a, b).collect():  # at most `most` records
        i, j = at[r["i"]], at[r["j"]]
        ma[i, j] = ma[j, i] = r[a]
        mb[i, j] = mb[j, i] = r[b]
    upper = np.triu_indices(n, 1)
    x = _ranks(ma[upper])
    shared = spark.sparkContext.broadcast((x, mb, upper))

    def corr(x, m, upper) -> float:
        y = _ranks(m[upper])
        return float(np.corrcoef(x, y)[0, 1]) if len(y) > 1 and x.std() > 0 and y.std() > 0 else 0.0

    observed = corr(x, mb, upper)

    def run(batches):
        import pandas as pd

        x, m, upper = shared.value
        for batch in batches:
            hits = 0
            for k in batch["id"]:
                p = np.random.default_rng([seed, int(k)]).permutation(len(m))
                hits += corr(x, m[np.ix_(p, p)], upper) >= observed
            yield pd.DataFrame({"hits": [hits]})

    hits = spark.range(permutations).mapInPandas(run, "hits long").agg(F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"))
    return hits.select(F.lit(round(observed, 3)).alias("r"), F.round((F.col("hits") + 1) / (permutations + 1), 4).alias("p"), F.lit(n).alias("n"))
