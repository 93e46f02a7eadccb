"""Queries of tournaments, behaviour and structure over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.functions import text as T
from simlattice.operators import behaviour as B
from simlattice.operators import evaluate as E
from simlattice.operators import pairs as P
from simlattice.operators import structure as S
from simlattice.operators import tournament as G
from simlattice.plans.text_queries import table


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as runs: agents are ship months, tasks line numbers and discounts; a run passes unless it was returned."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.concat(F.lit("m"), F.month("l_shipdate")).alias("agent_id"), F.concat("l_linenumber", F.lit("-"), F.round(F.col("l_discount") * 100).cast("int")).alias("task_id"), F.concat(F.lit("c"), "l_linenumber").alias("capability"), F.lit(0).alias("rep"),
        F.when(F.col("l_linestatus") == "O", "model-b").alias("requested_model"), (F.col("l_returnflag") != "R").alias("passed"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).alias("cost_usd"),
    )


def _rounded(df: DataFrame, *keys: str, digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in df.columns if c not in keys])


def tournament_cells(spark, sf_dir):
    return _rounded(G.cells(_results(spark, sf_dir)), "agent_id", "task_id")


def complete_tasks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).cast("string").alias("agent_id"), (F.col("l_partkey") % 300).cast("string").alias("task_id"), (F.col("l_returnflag") != "R").alias("passed"), F.col("l_tax").alias("cost_usd"))
    return G.complete(G.cells(rows)).select("task_id").distinct()


def tournament_ranking(spark, sf_dir):
    return _rounded(G.ranking(_results(spark, sf_dir)), "agent_id", "passes", "runs")


def model_ranking(spark, sf_dir):
    return _rounded(G.ranking(G.of_model(_results(spark, sf_dir), "model-a", "model-a")), "agent_id", "passes", "runs")


def capability_rates(spark, sf_dir):
    return _rounded(G.by_capability(_results(spark, sf_dir)), "agent_id", "capability")


def task_difficulty(spark, sf_dir):
    return _rounded(G.difficulty(_results(spark, sf_dir)), "task_id")


def bootstrap_intervals(spark, sf_dir):
    return _rounded(G.bootstrap(G.complete(G.cells(_results(spark, sf_dir))), 200), "agent_id", "rank_low", "rank_high", digits=5)


def paired_cost(spark, sf_dir):
    return _rounded(G.paired_cost(_results(spark, sf_dir), "m1", 200), "agent_id", digits=5)


def job_grid(spark, sf_dir):
    agents = table(spark, sf_dir, "nation").select(F.col("n_name").alias("agent_id"))
    tasks = table(spark, sf_dir, "region").select(F.col("r_name").alias("task_id"))
    done = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.lit(0).alias("rep"), F.col("r_name").alias("task_id"), F.col("n_name").alias("agent_id"))
    return G.job_grid(agents, tasks, 2, done)


def run_status(spark, sf_dir):
    out = G.run_status(_results(spark, sf_dir), 100000)
    return out.select(F.col("queued").cast("long").alias("queued"), "done", "passed", "failed", F.round("cost", 2).alias("cost"))


def claim_coverage(spark, sf_dir):
    claims = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("agent_id")).agg(F.collect_set("event_type").alias("capability_ids"))
    return G.coverage(G.claim_bridge(claims))


def _answers(spark, sf_dir):
    """Embeddings as answers: agents are labels, probes and replicates follow from the id."""
    rows = table(spark, sf_dir, "embeddings")
    return rows.select(F.concat(F.lit("a"), "label").alias("agent"), ((F.col("vec_id") / 10).cast("long") % 5).alias("probe"), ((F.col("vec_id") / 50).cast("long") % 2).alias("rep"), T.unit("embedding").alias("v"))


def content_distances(spark, sf_dir):
    return _rounded(B.content_distances(_answers(spark, sf_dir)), "i", "j")


def noise_ceiling(spark, sf_dir):
    return _rounded(B.noise_ceiling(_answers(spark, sf_dir)))


def _turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    flags = F.array(*[(F.length("text") % k == 0).cast("double") for k in (2, 3, 5, 7, 11, 13)])
    return rows.select(F.concat(F.lit("a"), F.col("conv_id") % 12).alias("agent"), flags.alias("disposition"), T.structure_features("text").alias("style"), F.when(F.col("turn") > 0, (F.col("turn") % 3) / 2).alias("caught"), F.when(F.col("turn") == 3, "max_tokens").alias("stop_reason"), F.struct(F.length("text").alias("input"), F.col("turn").alias("output")).alias("usage"))


def disposition_distances(spark, sf_dir):
    return _rounded(B.disposition_distances(_turns(spark, sf_dir)), "i", "j")


def structure_distances(spark, sf_dir):
    return _rounded(B.structure_distances(_turns(spark, sf_dir)), "i", "j")


def agent_summary(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    out = B.agent_summary(turns, B.disposition_distances(turns), "a0")
    return out.select("agent", "n", "truncated", F.col("tokens_in").cast("long").alias("tokens_in"), F.col("tokens_out").cast("long").alias("tokens_out"), F.round("caught_rate", 6).alias("caught_rate"), F.round("from_baseline", 6).alias("from_baseline"))


def pair_means(spark, sf_dir):
    d = B.content_distances(_answers(spark, sf_dir))
    pairs = table(spark, sf_dir, "nation").select(F.concat(F.lit("s"), F.col("n_nationkey") % 3).alias("stratum"), F.concat(F.lit("a"), F.col("n_nationkey") % 10).alias("i"), F.concat(F.lit("a"), F.col("n_regionkey")).alias("j"))
    return _rounded(B.pair_mean(pairs, d), "stratum", "n")


def judged_flags(spark, sf_dir):
    text = F.concat(F.lit('{"asked_clarifying_question": '), F.when(F.col("l_tax") > 0.04, "true").otherwise("false"), F.lit(', "declined_or_redirected": false, "pushed_back": true, "wrote_code": false, "wrote_tests": false, "flagged_security": true, "caught_planted_issue": "'), F.element_at(F.array(*[F.lit(x) for x in ("yes", "partly", "no", "n/a")]), (F.col("l_linenumber") % 4 + 1).cast("int")), F.lit('", "approach": "x"}'))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("key"), text.alias("text"))
    return B.judged(rows).groupBy("key").agg(F.round(F.avg(F.element_at("disposition", 1)), 6).alias("asked"), F.round(F.avg("caught"), 6).alias("caught"), F.count("caught").alias("judged"))


def spearman(spark, sf_dir):
    return _rounded(B.spearman(_two(spark, sf_dir)))


def _two(spark, sf_dir):
    a = B.disposition_distances(_turns(spark, sf_dir)).withColumnRenamed("d", "a")
    return a.join(B.structure_distances(_turns(spark, sf_dir)).withColumnRenamed("d", "b"), ["i", "j"]).withColumn("a", F.round("a", 9)).withColumn("b", F.round("b", 9))


def mantel(spark, sf_dir):
    return B.mantel(_two(spark, sf_dir))


def _estate(spark, sf_dir):
    """Parts' brands by what they are made of: a matrix whose size does not grow."""
    rows = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id"), F.col("p_type").alias("item")).agg(F.count("*").alias("n"))
    ids = rows.select("id").distinct().withColumn("row_idx", F.regexp_extract("id", "([0-9]+)", 1).cast("long"))
    return P.multiset_distances(rows).withColumn("d", F.round("d", 9)), ids


def joined_tree(spark, sf_dir):
    out = S.neighbour_joining(*_estate(spark, sf_dir))
    return out.select("node", "parent", F.round("length", 6).alias("length"), "name", F.round("depth", 6).alias("depth"))


def average_tree(spark, sf_dir):
    out = S.average_linkage(*_estate(spark, sf_dir))
    return out.select("node", "parent", F.round("length", 6).alias("length"), "name")


def density_clusters(spark, sf_dir):
    return S.hdbscan(*_estate(spark, sf_dir))


def greedy_clusters(spark, sf_dir):
    pairs, ids = _estate(spark, sf_dir)
    return S.greedy_clusters(pairs, ids, 0.6)


def compared_trees(spark, sf_dir):
    pairs, ids = _estate(spark, sf_dir)
    return _rounded(S.compare(S.neighbour_joining(pairs, ids), S.average_linkage(pairs, ids)))


def compared_clusters(spark, sf_dir):
    pairs, ids = _estate(spark, sf_dir)
    a, b = S.hdbscan(pairs, ids).withColumnRenamed("label", "a"), S.greedy_clusters(pairs, ids, 0.6).withColumnRenamed("label", "b")
    return _rounded(E.adjusted_rand(a.join(b, "id"), "a", "b"))


def nearest_unchanged(spark, sf_dir):
    pairs, _ = _estate(spark, sf_dir)
    halved = pairs.withColumn("d", F.when((F.col("i") > "Brand#3") & (F.col("j") > "Brand#3"), F.col("d") / 2).otherwise(F.col("d")))
    return _rounded(S.nearest_unchanged(P.nearest_of_each(pairs), P.nearest_of_each(halved)))


QUERIES = {f.__name__: f for f in (
    tournament_cells, complete_tasks, tournament_ranking, model_ranking, capability_rates, task_difficulty, bootstrap_intervals, paired_cost, job_grid, run_status, claim_coverage, content_distances,
    noise_ceiling, disposition_distances, structure_distances, agent_summary, pair_means, judged_flags, spearman, mantel, joined_tree, average_tree, density_clusters, greedy_clusters,
    compared_trees, compared_clusters, nearest_unchanged,
)}

_RES = """r AS (SELECT 'm' || month(l_shipdate) AS agent_id, l_linenumber || '-' || round(l_discount * 100)::INT AS task_id, 'c' || l_linenumber AS capability, CASE WHEN l_linestatus = 'O' THEN 'model-b' END AS model, (l_returnflag <> 'R')::INT AS passed, CASE WHEN l_tax > 0.02 THEN l_quantity END AS cost FROM lineitem)"""
_CELL = "c AS (SELECT agent_id, task_id, avg(passed) AS passed, avg(coalesce(cost, 0)) AS cost FROM r GROUP BY 1, 2)"
_FULL = "f AS (SELECT * FROM c WHERE task_id IN (SELECT task_id FROM c GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT agent_id) FROM c)))"
_RANKING = """o AS (SELECT agent_id, avg(passed) AS p, avg(cost) AS m FROM f GROUP BY 1), n AS (SELECT agent_id, sum(passed) AS passes, count(*) AS runs FROM r GROUP BY 1), q AS (SELECT *, passes::DOUBLE / runs AS x, 1.96 * 1.96 AS z FROM n),
w AS (SELECT *, (x + z / (2 * runs)) / (1 + z / runs) AS c, 1.96 / (1 + z / runs) * sqrt(x * (1 - x) / runs + z / (4.0 * runs * runs)) AS h FROM q)
SELECT agent_id, round(p, 6) AS pass_rate, round(m, 6) AS mean_cost, passes::BIGINT AS passes, runs::BIGINT AS runs, round(greatest(0, c - h), 6) AS wilson_low, round(least(1, c + h), 6) AS wilson_high FROM w LEFT JOIN o USING (agent_id)"""


def _draws(cell: str, boots: int) -> str:
    return f"tk AS (SELECT task_id, row_number() OVER (ORDER BY task_id) - 1 AS no FROM (SELECT DISTINCT task_id FROM {cell})), dr AS (SELECT b.b AS boot, ('0x' || substr(md5('0:' || b.b || ':' || p.no), 1, 7))::BIGINT % (SELECT count(*) FROM tk) AS no FROM range({boots}) b(b), tk p), dw AS MATERIALIZED (SELECT boot, task_id, count(*) AS times FROM dr JOIN tk USING (no) GROUP BY 1, 2)"


_ANS = "an AS MATERIALIZED (SELECT 'a' || label AS agent, (vec_id // 10) % 5 AS probe, (vec_id // 50) % 2 AS rep, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"
_MEAN = "ex AS (SELECT agent, probe, unnest(v) AS x, generate_subscripts(v, 1) AS k FROM an), mv AS (SELECT agent, probe, k, avg(x) AS x FROM ex GROUP BY 1, 2, 3), ml AS (SELECT agent, probe, sqrt(sum(x * x)) AS l FROM mv GROUP BY 1, 2), mu AS (SELECT agent, probe, k, x / l AS x FROM mv JOIN ml USING (agent, probe)), cp AS (SELECT a.agent AS i, b.agent AS j, a.probe, 1 - sum(a.x * b.x) AS d FROM mu a JOIN mu b ON a.probe = b.probe AND a.k = b.k AND a.agent < b.agent GROUP BY 1, 2, 3), cd AS (SELECT i, j, avg(d) AS d FROM cp GROUP BY 1, 2)"
_FLAG = "tn AS (SELECT 'a' || conv_id % 12 AS agent, turn, text, length(text) AS n FROM conversations), pf AS (SELECT agent, " + ", ".join(f"avg((n % {k} = 0)::INT) AS f{k}" for k in (2, 3, 5, 7, 11, 13)) + " FROM tn GROUP BY 1), dd AS (SELECT a.agent AS i, b.agent AS j, (" + " + ".join(f"abs(a.f{k} - b.f{k})" for k in (2, 3, 5, 7, 11, 13)) + ") / 6 AS d FROM pf a JOIN pf b ON a.agent < b.agent)"
_STY = r"""sl AS (SELECT 'a' || conv_id % 12 AS agent, text, list_transform(string_split_regex(text, '\n'), lambda r: ltrim(r)) AS l FROM conversations),
sf AS (SELECT agent, ln(1 + len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> ''))) AS s1, len(list_filter(l, lambda r: starts_with(r, '#')))::DOUBLE AS s2, floor((length(text) - length(replace(text, '```', ''))) / 3 / 2)::DOUBLE AS s3,
len(list_filter(l, lambda r: starts_with(r, '- ') OR starts_with(r, '* ')))::DOUBLE AS s4, len(list_filter(l, lambda r: regexp_matches(r, '^[0-9]\.(\.|$)')))::DOUBLE AS s5, (length(text) - length(replace(text, '?', '')))::DOUBLE AS s6 FROM sl),
sp AS (SELECT agent, """ + ", ".join(f"avg(s{k}) AS s{k}" for k in range(1, 7)) + " FROM sf GROUP BY 1), sz AS (SELECT agent, " + ", ".join(f"(s{k} - avg(s{k}) OVER ()) / (stddev_pop(s{k}) OVER () + 1e-9) AS s{k}" for k in range(1, 7)) + " FROM sp), sd AS (SELECT a.agent AS i, b.agent AS j, sqrt(" + " + ".join(f"(a.s{k} - b.s{k}) ** 2" for k in range(1, 7)) + ") AS d FROM sz a JOIN sz b ON a.agent < b.agent)"
_BRAND = "bx AS (SELECT p_brand AS id, p_type AS item, count(*) AS n FROM part GROUP BY 1, 2), bt AS (SELECT id, sum(n) AS t FROM bx GROUP BY 1), bk AS (SELECT a.id AS i, b.id AS j, sum(least(a.n, b.n)) AS k FROM bx a JOIN bx b USING (item) WHERE a.id < b.id GROUP BY 1, 2), bd AS (SELECT i, j, round(1 - k::DOUBLE / (x.t + y.t - k), 9) AS d FROM bk JOIN bt x ON x.id = i JOIN bt y ON y.id = j)"


def _nn(name: str, d: str) -> str:
    return f"{name} AS (SELECT i, arg_min(j, (d, j)) AS j FROM (SELECT i, j, {d} AS d FROM bd UNION ALL SELECT j, i, {d} FROM bd) GROUP BY 1)"


ORACLE = {
    "tournament_cells": f"WITH {_RES}, {_CELL} SELECT agent_id, task_id, round(passed, 6) AS passed, round(cost, 6) AS cost FROM c",
    "complete_tasks": "WITH c AS (SELECT DISTINCT l_suppkey % 40 AS a, l_partkey % 300 AS t FROM lineitem) SELECT t::VARCHAR AS task_id FROM c GROUP BY t HAVING count(*) = (SELECT count(DISTINCT a) FROM c)",
    "tournament_ranking": f"WITH {_RES}, {_CELL}, {_FULL}, {_RANKING}",
    "model_ranking": f"WITH {_RES.replace('FROM lineitem)', 'FROM lineitem WHERE l_linestatus <> ' + chr(39) + 'O' + chr(39) + ')')}, {_CELL}, {_FULL}, {_RANKING}",
    "capability_rates": f"WITH {_RES}, {_CELL}, {_FULL}, k AS (SELECT task_id, max(capability) AS capability FROM r GROUP BY 1) SELECT agent_id, capability, round(avg(passed), 6) AS pass_rate FROM f JOIN k USING (task_id) GROUP BY 1, 2",
    "task_difficulty": f"WITH {_RES}, {_CELL}, {_FULL} SELECT task_id, round(avg(passed), 6) AS pass_rate FROM f GROUP BY 1",
    "bootstrap_intervals": f"""WITH {_RES}, {_CELL}, {_FULL}, {_draws('f', 200)}, m AS (SELECT boot, agent_id, sum(passed * times) / sum(times) AS p, sum(cost * times) / sum(times) AS c FROM f JOIN dw USING (task_id) GROUP BY 1, 2),
        k AS (SELECT *, rank() OVER (PARTITION BY boot ORDER BY round(p, 9) DESC) AS r FROM m) SELECT agent_id, round(quantile_cont(p, 0.025), 5) AS pass_low, round(quantile_cont(p, 0.975), 5) AS pass_high, round(quantile_cont(c, 0.025), 5) AS cost_low, round(quantile_cont(c, 0.975), 5) AS cost_high,
        floor(quantile_cont(r::DOUBLE, 0.025))::BIGINT AS rank_low, floor(quantile_cont(r::DOUBLE, 0.975))::BIGINT AS rank_high FROM k GROUP BY 1""",
    "paired_cost": f"""WITH {_RES}, {_CELL}, b AS (SELECT task_id, cost AS base FROM c WHERE agent_id = 'm1'), x AS (SELECT c.agent_id, task_id, cost, base FROM c JOIN b USING (task_id) WHERE agent_id <> 'm1'), y AS (SELECT * FROM x WHERE agent_id IN (SELECT agent_id FROM x GROUP BY 1 HAVING count(*) = (SELECT count(*) FROM b))),
        {_draws('b', 200)}, p AS (SELECT agent_id, sum(cost) / sum(base) - 1 AS e FROM y GROUP BY 1), o AS (SELECT agent_id, boot, sum(cost * times) / sum(base * times) - 1 AS v FROM y JOIN dw USING (task_id) GROUP BY 1, 2), e AS (SELECT agent_id, quantile_cont(v, 0.025) AS l, quantile_cont(v, 0.975) AS h FROM o GROUP BY 1)
        SELECT agent_id, round(e, 5) AS extra_cost, round(l, 5) AS low, round(h, 5) AS high FROM p JOIN e USING (agent_id)""",
    "job_grid": "SELECT rep, r_name AS task_id, n_name AS agent_id FROM nation, region, (VALUES (0), (1)) v(rep) WHERE NOT (rep = 0 AND n_regionkey = r_regionkey)",
    "run_status": f"WITH {_RES} SELECT 100000::BIGINT AS queued, count(*)::BIGINT AS done, sum(passed)::BIGINT AS passed, (count(*) - sum(passed))::BIGINT AS failed, round(sum(cost), 2) AS cost FROM r",
    "claim_coverage": "SELECT event_type AS capability_id, count(DISTINCT user_id)::BIGINT AS agents FROM events GROUP BY 1",
    "content_distances": f"WITH {_ANS}, {_MEAN} SELECT i, j, round(d, 6) AS d FROM cd",
    "noise_ceiling": f"WITH {_ANS} SELECT round(avg(1 - list_dot_product(a.v, b.v)), 6) AS noise FROM an a JOIN an b ON a.agent = b.agent AND a.probe = b.probe AND a.rep = 0 AND b.rep = 1",
    "disposition_distances": f"WITH {_FLAG} SELECT i, j, round(d, 6) AS d FROM dd",
    "structure_distances": f"WITH {_STY} SELECT i, j, round(d, 6) AS d FROM sd",
    "agent_summary": f"""WITH {_FLAG}, s AS (SELECT agent, count(*) AS n, count(*) FILTER (turn = 3) AS t, sum(n) AS i, sum(turn) AS o, avg(CASE WHEN turn > 0 THEN (turn % 3) / 2 END) AS c FROM tn GROUP BY 1), b AS (SELECT CASE WHEN i = 'a0' THEN j ELSE i END AS agent, d FROM dd WHERE i = 'a0' OR j = 'a0')
        SELECT agent, n::BIGINT AS n, t::BIGINT AS truncated, i::BIGINT AS tokens_in, o::BIGINT AS tokens_out, round(c, 6) AS caught_rate, round(d, 6) AS from_baseline FROM s LEFT JOIN b USING (agent) WHERE agent <> 'a0'""",
    "pair_means": f"WITH {_ANS}, {_MEAN}, p AS (SELECT 's' || n_nationkey % 3 AS stratum, 'a' || n_nationkey % 10 AS x, 'a' || n_regionkey AS y FROM nation) SELECT stratum, count(*)::BIGINT AS n, round(avg(d), 6) AS mean FROM p JOIN cd ON i = least(x, y) AND j = greatest(x, y) GROUP BY 1",
    "judged_flags": "SELECT l_suppkey AS key, round(avg((l_tax > 0.04)::INT), 6) AS asked, round(avg(CASE l_linenumber % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.0 END), 6)::DOUBLE AS caught, (count(*) FILTER (l_linenumber % 4 < 3))::BIGINT AS judged FROM lineitem GROUP BY 1",
    "spearman": f"WITH {_FLAG}, {_STY}, p AS (SELECT round(dd.d, 9) AS a, round(sd.d, 9) AS b FROM dd JOIN sd USING (i, j)), r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS y FROM p) SELECT round(corr(x, y), 6) AS r FROM r",
    "nearest_unchanged": f"WITH {_BRAND}, {_nn('na', 'd')}, {_nn('nb', 'CASE WHEN i > ' + chr(39) + 'Brand#3' + chr(39) + ' AND j > ' + chr(39) + 'Brand#3' + chr(39) + ' THEN d / 2 ELSE d END')} SELECT round(avg((na.j = nb.j)::INT), 6) AS unchanged FROM na JOIN nb USING (i)",
}
