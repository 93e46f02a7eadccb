"""Record operators: exact dedup, identities, boilerplate, modules, families, and the set questions asked of them.

Order is a column, row_idx: whatever comes first or wins a tie does so by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from simlattice.functions.text import clean_id, collapse, lines, text_of


def first_of_equal(df: DataFrame, order: str = "row_idx") -> DataFrame:
    """Keeps the first of records that are equal in every other column, as JSON with sorted keys.

    Groups are aggregated by a digest, so copies of any number meet as one candidate per task."""
    own = [c for c in df.columns if c != order]
    key = F.sha2(F.to_json(F.struct(*sorted(own)), {"ignoreNullFields": "false"}), 256)
    return df.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*df.columns), order).alias("_r")).select("_r.*")


def dedupe_copies(df: DataFrame, purpose: str = "purpose", prompt: str = "prompt", path: str = "source_path", order: str = "row_idx") -> DataFrame:
    """Keeps the first of records with equal purpose and prompt; copies is the others' paths in order, null if there are none."""
    key = F.sha1(F.concat(text_of(purpose), F.lit("\n"), text_of(prompt)))
    grouped = df.groupBy(key.alias("_k")).agg(F.min_by(F.struct(*df.columns), order).alias("_r"), F.array_sort(F.collect_list(F.struct(order, path))).alias("_p"))
    copies = F.transform(F.slice("_p", F.lit(2), F.size("_p")), lambda x: x[path])
    return grouped.select("_r.*", F.when(F.size("_p") > 1, copies).alias("copies"))


def assign_ids(df: DataFrame, source: str = "source", name: str = "name", order: str = "row_idx") -> DataFrame:
    """agent_id is source/name, cleaned; the k-th repeat of one gets ~k. A name that ends so by itself may meet a repeat's id."""
    nth = F.row_number().over(Window.partitionBy("_base").orderBy(order))
    return df.withColumn("_base", clean_id(source, name)).withColumn("_nth", nth).withColumn("agent_id", F.when(F.col("_nth") > 1, F.concat("_base", F.lit("~"), "_nth")).otherwise(F.col("_base"))).drop("_base", "_nth")


def strip_lines(df: DataFrame, id_col: str, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Within each text, drops lines whose share of its non-blank lines is over the threshold; blank lines stay."""
    rows = df.select(F.col(id_col).alias("_id"), F.posexplode(lines(text)).alias("_i", "_line")).withColumn("_k", F.md5(F.trim("_line")))
    counted = rows.filter(F.trim("_line") != "").groupBy("_id", "_k").agg(F.count("*").alias("_c"))
    size = counted.groupBy("_id").agg(F.sum("_c").alias("_n"))
    often = counted.join(size, "_id").filter(F.col("_c") > threshold * F.col("_n")).select("_id", "_k")
    kept = rows.join(often, ["_id", "_k"], "left_anti").groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_line"))), lambda x: x["_line"]), "\n").alias("stripped"))
    return df.join(kept, F.col(id_col) == F.col("_id"), "left").select(id_col, F.coalesce("stripped", F.lit("")).alias("stripped"))


def strip_source_boilerplate(df: DataFrame, id_col: str = "doc_id", source: str = "source", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Drops lines that stand in more texts of their source than the larger of 2 and threshold times its texts.

    Lines compare in lower case without blanks at their ends; kept lines stay as written. Lines' text moves once, as digests."""
    base = df.select(F.col(id_col).alias("_id"), F.col(source).alias("_s"), F.posexplode(lines(text)).alias("_i", "_line"))
    base = base.withColumn("_k", F.md5(F.lower(F.trim("_line")))).filter(F.trim("_line") != "")
    sizes = df.groupBy(F.col(source).alias("_s")).agg(F.count("*").alias("_n"))
    often = base.groupBy("_s", "_k").agg(F.count_distinct("_id").alias("_df")).join(sizes, "_s").filter(F.col("_df") > F.greatest(F.col("_n") * threshold, F.lit(2))).select("_s", "_k")
    kept = base.join(often, ["_s", "_k"], "left_anti").groupBy("_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_line"))), lambda x: x["_line"]), "\n").alias("stripped"))
    return df.join(kept, F.col(id_col) == F.col("_id"), "left").select(id_col, F.coalesce("stripped", F.lit("")).alias("stripped"))


def sections(df: DataFrame, id_col: str, text: str = "prompt") -> DataFrame:
    """(id, k, label, content): a block begins at a line that starts with #; blank lines go before blocks are made."""
    rows = df.select(id_col, F.filter(lines(text), lambda x: F.trim(x) != "").alias("_l")).filter(F.size("_l") > 0)
    starts = F.filter(F.sequence(F.lit(0), F.size("_l") - 1), lambda i: (i == 0) | F.startswith(F.ltrim(F.element_at("_l", i + 1)), F.lit("#")))
    rows = rows.withColumn("_s", starts)
    blocks = F.transform(F.col("_s"), lambda s, k: F.array_join(F.slice("_l", s + 1, F.coalesce(F.try_element_at("_s", k + 2), F.size("_l")) - s), "\n"))
    out = rows.select(id_col, F.posexplode(blocks).alias("k", "content"))
    head = F.trim(F.element_at(F.split("content", "\n"), 1))
    return out.withColumn("label", F.when(head.startswith("#"), F.trim(F.regexp_replace(head, r"^#+", "")))).select(id_col, "k", "label", "content")


def modules(df: DataFrame, path: str = "source_path") -> DataFrame:
    """The prompt's sections and the tools of each record, as schema.MODULE. The id falls back to the path, then to `unknown`."""
    own = df.withColumn("_id", F.coalesce(F.expr("nullif(agent_id, '')"), F.expr(f"nullif({path}, '')"), F.lit("unknown")))
    prompt = sections(own, "_id").select(F.concat_ws(":", "_id", F.lit("prompt"), "k").alias("module_id"), F.col("_id").alias("agent_id"), F.lit("prompt").alias("kind"), F.coalesce("label", F.lit("prompt")).alias("label"), "content", F.lit(None).cast("string").alias("reference"))
    tools = own.select("_id", F.posexplode("tools").alias("k", "tool")).select(F.concat_ws(":", "_id", F.lit("tool"), "k").alias("module_id"), F.col("_id").alias("agent_id"), F.lit("tool").alias("kind"), F.col("tool").alias("label"), F.col("tool").alias("content"), F.lit(None).cast("string").alias("reference"))
    return prompt.unionByName(tools)


def families(df: DataFrame, member: str = "agent_id", content: str = "content") -> DataFrame:
    """(family, member): members whose content is equal in lower case without blanks at its ends; no content is `empty`."""
    key = F.coalesce(F.expr(f"nullif(lower(trim({content})), '')"), F.lit("empty"))
    return df.select(key.alias("family"), F.col(member).alias("member"))


def copy_debt(pairs: DataFrame, least: int = 3) -> DataFrame:
    """Families with so many members or more; a member counts as often as it is there."""
    return pairs.groupBy("family").agg(F.count("*").alias("members")).filter(F.col("members") >= least)


def pan_genome(pairs: DataFrame) -> DataFrame:
    """The sorted families of each member."""
    return pairs.groupBy("member").agg(F.array_sort(F.collect_set("family")).alias("families"))


def shared_needs(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """How many clusters have a member of each family; families with none stay. clusters(cluster, member)."""
    return pairs.join(clusters, "member", "left").groupBy("family").agg(F.count_distinct("cluster").alias("clusters"))


def transfer_candidates(pairs: DataFrame, vertical: DataFrame | None = None, functional: DataFrame | None = None, far: float = 0.3, near: float = 0.5) -> DataFrame:
    """(a, b, shared): members that share families. Given both tables (a, b, d), only pairs with vertical below far and functional
    above near; a missing vertical is 1, and a pair is not looked up the other way round.

    Each member stands once in a family. A family gives all its pairs, as the question asks: use families of bounded size."""
    own = pairs.distinct()
    met = own.select("family", F.col("member").alias("a")).join(own.select("family", F.col("member").alias("b")), "family").filter("a < b")
    out = met.groupBy("a", "b").agg(F.array_sort(F.collect_list("family")).alias("shared"))
    if vertical is None or functional is None:
        return out
    v, f = vertical.select("a", "b", F.col("d").alias("_v")), functional.select("a", "b", F.col("d").alias("_f"))
    return out.join(v, ["a", "b"], "left").join(f, ["a", "b"], "left").filter((F.coalesce("_v", F.lit(1.0)) < far) & (F.coalesce("_f", F.lit(0.0)) > near)).drop("_v", "_f")


def looked_up(wanted: DataFrame, scores: DataFrame) -> DataFrame:
    """wanted(a, b) with score from scores(a, b, score), either way round, else 0."""
    there = scores.select("a", "b", F.col("score").alias("_s"))
    back = scores.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("score").alias("_t"))
    return wanted.join(there, ["a", "b"], "left").join(back, ["a", "b"], "left").select(*wanted.columns, F.coalesce("_s", "_t", F.lit(0.0)).alias("score"))


def merge_candidates(wanted: DataFrame, similarity: DataFrame, least: float = 0.7) -> DataFrame:
    return looked_up(wanted, similarity).filter(F.col("score") >= least)


def drift_pairs(wanted: DataFrame, distance: DataFrame, least: float = 0.5) -> DataFrame:
    return looked_up(wanted, distance).filter(F.col("score") >= least)


def todo(requests: DataFrame, store: DataFrame, key: str = "key") -> DataFrame:
    """Requests whose key the store does not have, once each."""
    return requests.join(store.select(key), key, "left_anti").dropDuplicates([key])


def in_flight(log: DataFrame) -> DataFrame:
    """(phase, key) of keys whose last event is `submitted`. log(seq, phase, event, keys): an errored key that no `collected` event
    names stays in flight."""
    rows = log.select("seq", "phase", "event", F.explode("keys").alias("key"))
    return rows.groupBy("phase", "key").agg(F.max_by("event", "seq").alias("event")).filter("event = 'submitted'").select("phase", "key")


def to_judge(responses: DataFrame, judgments: DataFrame, flying: DataFrame, key: str = "key") -> DataFrame:
    """Responses that have no judgment and are not in flight."""
    return responses.join(judgments.select(key), key, "left_anti").join(flying.select(key), key, "left_anti")


def relation(a: Column, b: Column, labels: dict[tuple[str, str], str], default: str = "other repos") -> Column:
    """The label of an unordered pair of sources; labels has pairs in order."""
    out = F.lit(default)
    for (x, y), label in labels.items():
        out = F.when((F.least(a, b) == x) & (F.greatest(a, b) == y), label).otherwise(out)
    return out


def request_grid(agents: DataFrame, probes: DataFrame, reps: int, baseline: str | None = None) -> DataFrame:
    """(agent_id, probe_id, rep) for every agent, and the baseline if one is given; a plan's grid is its result, and small."""
    own = agents.select("agent_id")
    if baseline is not None:
        own = own.unionByName(own.sparkSession.createDataFrame([(baseline,)], "agent_id string"))
    return own.join(probes.select(F.col("id").alias("probe_id")), F.lit(True)).withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))


def estimate_cost(agents: DataFrame, probes: DataFrame, reps: int, price: tuple[float, float] = (4.0, 20.0), judge: tuple[float, float] = (4.0, 20.0)) -> DataFrame:
    """Calls and dollars of a plan at (input, output) prices for a million tokens.

    A sum over all agents and probes is taken from the sums over each, without their product."""
    a = agents.agg(F.count("*").alias("na"), F.coalesce(F.sum(F.length(text_of("system"))), F.lit(0)).alias("ca"))
    p = probes.agg(F.count("*").alias("np"), F.coalesce(F.sum(F.length(text_of("prompt"))), F.lit(0)).alias("cp"))
    one = a.join(p, F.lit(True))  # one row each
    calls = F.col("na") * F.col("np") * reps
    given = ((F.col("ca") * F.col("np") + F.col("cp") * F.col("na")) / 4 + F.col("na") * F.col("np") * 50) * reps
    respond = (given * price[0] + calls * 1200 * price[1]) / 1e6
    judged = (calls * 1800 * judge[0] + calls * 400 * judge[1]) / 1e6
    return one.select(calls.alias("calls"), F.round(respond, 2).alias("respond_usd"), F.round(judged, 2).alias("judge_usd"), F.round(respond + judged, 2).alias("total_usd"))


def reasons(rules: dict[str, Column]) -> Column:
    """The names of the rules that hold, in order: why a row is not valid."""
    return F.filter(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())


def validate_tasks(tasks: DataFrame) -> DataFrame:
    """Structural rules by task type; whether code passes its tests comes with the row, as reference_passes and buggy_passes."""
    blank = lambda c: F.trim(text_of(c)) == ""
    verifiable = F.col("type") == "verifiable"
    rules = {
        "no prompt": blank("prompt"),
        "no buggy code": verifiable & blank("buggy_code"),
        "no test code": verifiable & blank("test_code"),
        "no reference code": verifiable & blank("reference_code"),
        "reference fails": verifiable & ~F.coalesce("reference_passes", F.lit(True)),
        "buggy code passes": verifiable & F.coalesce("buggy_passes", F.lit(False)),
        "no rubric": ~verifiable & (F.coalesce(F.size("rubric"), F.lit(0)) <= 0),
    }
    return tasks.withColumn("reasons", reasons(rules)).withColumn("valid", F.size("reasons") == 0)


def rescore(results: DataFrame, verdicts: DataFrame, version: int = 2) -> DataFrame:
    """Results with newer verdicts(key, passed) where an answer has an older version; passed_before keeps the old one."""
    new = verdicts.select("key", F.col("passed").alias("_new"))
    stale = (F.coalesce("scorer_version", F.lit(1)) < version) & (text_of("answer") != "") & F.col("_new").isNotNull()
    out = results.join(new, "key", "left")
    return out.select(
        *[c for c in results.columns if c not in ("passed", "scorer_version")],
        F.when(stale, F.col("_new")).otherwise(F.col("passed")).alias("passed"),
        F.when(stale, F.col("passed")).alias("passed_before"),
        F.when(stale, F.lit(version)).otherwise(F.col("scorer_version")).alias("scorer_version"),
    )


def sample_sources(records: DataFrame, source: str, stem: Column, n: int = 50, least_words: int = 150, seed: int = 7) -> DataFrame:
    """One record for each stem of a source, of those with enough words, n of them, in the order of a seeded hash."""
    words = F.size(F.split(collapse("prompt"), " "))
    order = F.md5(F.concat_ws("|", F.lit(seed), "agent_id"))
    rows = records.filter((F.col("source") == source) & (words >= least_words)).withColumn("_o", order).withColumn("_stem", stem)
    first = rows.groupBy("_stem").agg(F.min_by(F.struct(*rows.columns), "_o").alias("_r")).select("_r.*")
    return first.orderBy("_o").limit(n).drop("_o", "_stem")


def select_agents(twins: list[tuple[str, str]], near: list[tuple[str, str]], rest: list[str], n: int) -> list[tuple[str, str]]:
    """(agent, stratum): twins to 40% of n, near pairs to 70%, then single ones; pairs are disjoint. Lists come in drawing order and
    hold no more than a plan's candidates, so this is done on the driver."""
    chosen: dict[str, str] = {}
    for pairs, stratum, budget in ((twins, "twin", int(n * 0.4)), (near, "near", int(n * 0.7))):
        for a, b in pairs:
            if len(chosen) + 2 > budget:
                break
            if a not in chosen and b not in chosen:
                chosen[a] = chosen[b] = stratum
    singles = [x for x in rest if x not in chosen]
    chosen.update((x, "random") for x in singles[: max(0, n - len(chosen))])
    return list(chosen.items())
