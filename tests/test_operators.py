"""Operators on records, pairs, vectors, evaluation, tournaments and behaviour, against known answers and plain versions."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlattice.functions import text as T
from simlattice.operators import behaviour as B
from simlattice.operators import evaluate as E
from simlattice.operators import pairs as P
from simlattice.operators import placing
from simlattice.operators import records as R
from simlattice.operators import tournament as G
from simlattice.operators import vectors as V
from simlattice.sources import records as S


def rows_of(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


def test_dedup_and_ids(spark):
    rows = [(0, "a", "x", "p", "q", "1"), (1, "a", "x", "p", "q", "2"), (2, "a", "x", "p", "other", "3")]
    df = spark.createDataFrame(rows, "row_idx long, source string, name string, purpose string, prompt string, source_path string")
    out = R.dedupe_copies(df)
    assert rows_of(out.select("row_idx", F.array_join("copies", ",").alias("c")).fillna(""), "row_idx", "c") == [(0, "2"), (2, "")]
    assert rows_of(R.assign_ids(out), "agent_id") == [("a/x",), ("a/x~2",)]
    assert R.first_of_equal(df.drop("source_path")).count() == 2
    assert R.dedupe_copies(df.limit(0)).count() == 0


def test_boilerplate(spark):
    rows = [(i, "s", f"Shared line\nunique {i}\n\n shared LINE ") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert rows_of(R.strip_source_boilerplate(df), "doc_id", "stripped") == [(i, f"unique {i}") for i in range(5)]
    one = spark.createDataFrame([(1, "x\nx\ny\n"), (2, None), (3, "a\n\nb")], "doc_id long, text string")
    assert rows_of(R.strip_lines(one, "doc_id", threshold=0.5), "doc_id", "stripped") == [(1, "y"), (2, ""), (3, "a\n\nb")]


def test_sections_and_modules(spark):
    df = spark.createDataFrame([("a", "p", "intro\n\n# One\ntext\n## Two\n", ["t", "u"]), ("", "path", "only", []), ("c", "", "", [])], "agent_id string, source_path string, prompt string, tools array<string>")
    got = rows_of(R.sections(df, "agent_id"), "agent_id", "k", "content")
    assert got == [("", 0, "only"), ("a", 0, "intro"), ("a", 1, "# One\ntext"), ("a", 2, "## Two")]
    ids = {r["module_id"] for r in R.modules(df).collect()}
    assert ids == {"a:prompt:0", "a:prompt:1", "a:prompt:2", "a:tool:0", "a:tool:1", "path:prompt:0"}


def test_families_and_estate(spark):
    mods = spark.createDataFrame([("a", " Read "), ("b", "read"), ("c", "read"), ("a", ""), ("b", None)], "agent_id string, content string")
    fam = R.families(mods)
    assert rows_of(R.copy_debt(fam), "family", "members") == [("read", 3)]
    assert rows_of(R.pan_genome(fam).withColumn("f", F.array_join("families", ",")), "member", "f") == [("a", "empty,read"), ("b", "empty,read"), ("c", "read")]
    clusters = spark.createDataFrame([("1", "a"), ("2", "b")], "cluster string, member string")
    assert rows_of(R.shared_needs(fam, clusters), "family", "clusters") == [("empty", 2), ("read", 2)]
    d = lambda x: spark.createDataFrame([("a", "b", x)], "a string, b string, d double")
    assert rows_of(R.transfer_candidates(fam, d(0.1), d(0.8)), "a", "b") == [("a", "b")]
    assert R.transfer_candidates(fam, d(0.4), d(0.8)).count() == 0
    assert R.transfer_candidates(fam).count() == 3
    wanted = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "c")], "a string, b string")
    scores = spark.createDataFrame([("a", "b", 0.8)], "a string, b string, score double")
    assert R.merge_candidates(wanted, scores).count() == 2 and R.drift_pairs(wanted, scores).count() == 2


def test_requests(spark):
    requests = spark.createDataFrame([("1",), ("2",), ("2",), ("3",)], "key string")
    store = spark.createDataFrame([("3",)], "key string")
    assert rows_of(R.todo(requests, store), "key") == [("1",), ("2",)]
    log = spark.createDataFrame([(1, "r", "submitted", ["a", "b"]), (2, "r", "collected", ["a"]), (3, "j", "submitted", ["a"])], "seq long, phase string, event string, keys array<string>")
    assert rows_of(R.in_flight(log), "phase", "key") == [("j", "a"), ("r", "b")]
    agents = spark.createDataFrame([("a",), ("b",)], "agent_id string")
    probes = spark.createDataFrame([("p", "pp")], "id string, prompt string")
    assert R.request_grid(agents, probes, 2, "base").count() == 6
    cost = R.estimate_cost(agents.withColumn("system", F.lit("x" * 100)), probes, 2).first()
    assert cost["calls"] == 4 and cost["respond_usd"] == round((2 * (102 / 4 + 50) * 2 * 4 + 4 * 1200 * 20) / 1e6, 2)
    assert R.select_agents([("a", "b"), ("b", "c")], [("d", "e"), ("a", "x")], list("abcdefgh"), 6) == [("a", "twin"), ("b", "twin"), ("d", "near"), ("e", "near"), ("c", "random"), ("f", "random")]
    late = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key string, seq int, v string")
    assert rows_of(S.latest(late), "key", "v") == [("k", "new")]


def test_rescore_and_rules(spark):
    results = spark.createDataFrame([("a", True, None, "x"), ("b", True, 2, "x"), ("c", True, None, "")], "key string, passed boolean, scorer_version int, answer string")
    verdicts = spark.createDataFrame([(k, False) for k in "abc"], "key string, passed boolean")
    assert rows_of(R.rescore(results, verdicts).fillna(False, ["passed_before"]), "key", "passed", "passed_before") == [("a", False, True), ("b", True, False), ("c", True, False)]


def random_sets(seed, n=80):
    rng = random.Random(seed)
    base = [rng.sample(range(60), rng.randint(1, 25)) for _ in range(n // 2)]
    more = [[x for x in s if rng.random() > 0.15] + [rng.randrange(60)] for s in base]
    return [(i, sorted({f"w{x}" for x in s})) for i, s in enumerate(base + more)]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similarity_join(spark, least):
    rows = random_sets(3)
    got = {(r["i"], r["j"]): r["similarity"] for r in P.similarity_join(spark.createDataFrame(rows, "id long, items array<string>"), least).collect()}
    want = {}
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        s = len(set(a) & set(b)) / len(set(a) | set(b))
        if s >= least:
            want[(i, j)] = s
    assert got == pytest.approx(want)


@pytest.mark.parametrize("least", [0.4, 0.8])
def test_similarity_join_in_blocks(spark, monkeypatch, least):
    monkeypatch.setattr(P.prefix, "SETS", 16)
    monkeypatch.setattr(P.prefix, "ENTRIES", 200)
    monkeypatch.setattr(P.prefix, "AT_ONCE", 256)
    rng = random.Random(11)
    rows = []
    for k in range(40):
        base = rng.sample(range(400), rng.choice((1, 3, 20, 20, 120)))
        rows += [(f"{k}-{c}", sorted({f"w{x if rng.random() > 0.1 * c else rng.randrange(400)}" for x in base} | {"the", "of"})) for c in range(3)]
    own = P.prefix.ordered(spark.createDataFrame(rows, "_id string, _items array<string>"))
    sizes = Counter(len(x) for _, x in rows)
    assert len(P.prefix._blocks(sizes, 0.5)) > 5 and any(parts > 1 for *_, parts in P.prefix._blocks(sizes, 0.5))
    want = {}
    for (i, a), (j, b) in itertools.combinations(sorted(rows), 2):
        s = len(set(a) & set(b)) / len(set(a) | set(b))
        if s >= least:
            want[(i, j)] = s
    met = [(r["i"], r["j"]) for r in P.prefix.candidates(own, least).collect()]
    assert len(met) == len(set(met)) and set(met) >= set(want)
    got = {(r["i"], r["j"]): r["similarity"] for r in P.similarity_join(spark.createDataFrame(rows, "id string, items array<string>"), least).collect()}
    assert got == pytest.approx(want) and len(want) > 40


def test_similarity_join_of_equal_hashes(spark):
    one, two = "3s05flz6" + "a" * 24 + "c6jq11as" + "a" * 24, "2sgzu0ta" + "a" * 24 + '[apfej">' + "a" * 24
    rows = spark.createDataFrame([(1, [one, two]), (2, [two, one]), (3, [one, "x"]), (4, [two, "x"]), (5, [one, "y", "z"])], "id long, items array<string>")
    assert rows.select(F.xxhash64(F.lit(one)) == F.xxhash64(F.lit(two))).first()[0]
    got = {(r["i"], r["j"]): r["similarity"] for r in P.similarity_join(rows, 0.5).collect()}
    assert got == {(1, 2): 1.0}


def test_top_pairs(spark):
    rows = random_sets(4)
    want = sorted(((-len(set(a) & set(b)) / len(set(a) | set(b)), i, j) for (i, a), (j, b) in itertools.combinations(rows, 2)))[:30]
    got = [(-r["similarity"], r["i"], r["j"]) for r in P.top_pairs(spark.createDataFrame(rows, "id long, items array<string>"), 30).collect()]
    assert got == [pytest.approx(x) for x in want]


def test_weighted_distances(spark):
    rows = [(i, x) for i, s in random_sets(5, 20) for x in s]
    n = 25
    df = Counter(x for _, x in rows)
    w = {x: math.log((n + 1) / (k + 1)) + 1 for x, k in df.items()}
    sets = {}
    for i, x in rows:
        sets.setdefault(i, set()).add(x)
    got = {(r["i"], r["j"]): r["d"] for r in P.weighted_set_distances(spark.createDataFrame(rows, "id long, item string"), n).collect()}
    for i, j in itertools.combinations(sorted(sets), 2):
        both = sum(w[x] for x in sorted(sets[i] & sets[j]))
        if sets[i] & sets[j]:
            assert got[(i, j)] == pytest.approx(1 - both / sum(w[x] for x in sorted(sets[i] | sets[j])))
        else:
            assert (i, j) not in got


def test_multiset_distance(spark):
    rows = [(1, "a", 3), (1, "b", 1), (2, "a", 1), (2, "c", 2), (3, "z", 1)]
    got = P.multiset_distances(spark.createDataFrame(rows, "id long, item string, n long")).collect()
    assert [(r["i"], r["j"], r["d"]) for r in got] == [(1, 2, pytest.approx(1 - 1 / 6))]


def test_minhash_follows_jaccard(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(30):
        own = [rng.choice(words) for _ in range(200)]
        rows.append((2 * i, " ".join(own)))
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(200)] = "edit"
        rows.append((2 * i + 1, " ".join(own)))
    df = spark.createDataFrame(rows, "id long, t string").select("id", "t", P.minhash("t", 64).alias("sketch"))
    text = dict(rows)
    gram = lambda t: {" ".join(t.split()[k : k + 5]) for k in range(196)}
    got = P.minhash_pairs(df, 4, 0.3).collect()
    errors = [r["similarity"] - len(gram(text[r["i"]]) & gram(text[r["j"]])) / len(gram(text[r["i"]]) | gram(text[r["j"]])) for r in got]
    assert len(got) > 15 and abs(np.mean(errors)) < 0.05 and np.abs(errors).max() < 0.25


def test_minhash_join_needs_no_band(spark):
    rng = random.Random(7)
    base = [rng.randrange(10**6) for _ in range(32)]
    # equal in two slots of every four: half the slots, but no band of four
    half = [x if k % 4 < 2 else x + 10**6 for k, x in enumerate(base)]
    rows = [(1, base), (2, half), (3, base)]
    for i in range(4, 60):
        rows.append((i, [rng.choice((x, rng.randrange(3))) for x in rng.choice(rows)[1]]))
    df = spark.createDataFrame(rows, "id long, sketch array<long>")
    first = {}
    for i, s in rows:
        first.setdefault(tuple(s), i)
    want = {(i, j): n / 32 for s, i in first.items() for t, j in first.items() if i < j and (n := sum(x == y for x, y in zip(s, t, strict=True))) >= 16}
    assert {(r["i"], r["j"]): r["similarity"] for r in P.minhash_join(df, 0.5).collect()} == want and want[(1, 2)] == 0.5
    assert (1, 2) not in {(r["i"], r["j"]) for r in P.minhash_pairs(df, 4, 0.5).collect()}
    assert {(r["class"], r["member"]) for r in P.sketch_members(df).collect()} >= {(1, 1), (1, 3)}


def test_shared_rare(spark):
    docs = ["dapper query mapper", "dapper handles mapper", "plain query text", "plain text", "query plain"]
    rows = spark.createDataFrame(list(enumerate(docs)), "id long, t string").select("id", F.explode(T.terms("t")).alias("item"))
    got = {(r["i"], r["j"]): (r["score"], r["terms"]) for r in P.shared_rare(rows, 5, 0).collect()}
    assert got[(0, 1)] == (pytest.approx(2 * math.log(5)), ["dapper", "mapper"])
    assert (0, 2) not in got


def test_traits(spark):
    tax = spark.createDataFrame([("language", "python", "python"), ("activity", "review", "code review"), ("activity", "review", "reviewing"), ("activity", "debug", "debugging")], "category string, trait string, phrase string")
    docs = spark.createDataFrame([(1, "python-debug", "Python code review", "reviewing, debugging. Pythonic python"), (2, "x", "", "none")], "id long, name string, purpose string, prompt string")
    got = {(r["id"], r["trait"]): r["weight"] for r in P.trait_matrix(docs, tax).collect()}
    assert got == {(1, "language:python"): pytest.approx(math.log(5)), (1, "activity:review"): pytest.approx(math.log(5)), (1, "activity:debug"): pytest.approx(math.log(2))}
    own = spark.createDataFrame([(1, "python-debug", "python-debug python debug", "")], "id long, name string, purpose string, prompt string")
    tax2 = spark.createDataFrame([("a", "python", "python-debug")], "category string, trait string, phrase string")
    assert P.trait_matrix(own, tax2, name="name").count() <= 1
    d = P.trait_distances(P.trait_matrix(docs.unionByName(docs.withColumn("id", F.col("id") + 10)), tax), 4).collect()
    assert [(r["i"], r["j"], round(r["d"], 9)) for r in d] == [(1, 11, 0.0)]


def test_twins_and_bands(spark):
    rows = [(0, "a", "x"), (1, "b", "x"), (2, "a", "x"), (3, "c", "y")]
    df = spark.createDataFrame(rows, "id long, source string, stem string").withColumn("row_idx", F.col("id"))
    assert rows_of(P.twin_pairs(df, "id", "stem", "source"), "i", "j") == [(0, 1), (1, 2)]
    assert rows_of(P.twin_counts(df, "stem", "source"), "sa", "sb", "twins") == [("a", "b", 2)]
    rng = random.Random(1)
    a, b = [(round(rng.random(), 3), i) for i in range(60)], [(round(rng.random(), 3), i) for i in range(60)]
    got = rows_of(P.band_join(spark.createDataFrame(a, "x double, a long"), spark.createDataFrame(b, "x_b double, b long"), "x", 0.03), "a", "b")
    assert got == sorted((i, j) for x, i in a for y, j in b if abs(x - y) <= 0.03)


def test_twins_of_one_stem_are_made_in_many_tasks(spark, monkeypatch):
    """Blocks of a frequent stem are dealt out, and no pair is lost or made twice; ties and nulls have none."""
    monkeypatch.setattr(P, "TWIN_BLOCK", 16, raising=False)
    rng = random.Random(3)
    rows = [(i, rng.choice("abc"), "x" if i % 9 else "y", rng.randrange(300)) for i in range(240)]
    rows += [(500, None, "x", 1), (501, "a", None, 2), (502, "b", "x", None), (503, "a", "z", 5)]
    df = spark.createDataFrame(rows, "id long, source string, stem string, row_idx long")
    want = sorted((i, j, s, t) for i, s, k, o in rows for j, t, m, p in rows if k == m and None not in (k, s, t, o, p) and o < p and s != t)
    twins = P.twin_pairs(df, "id", "stem", "source")
    assert rows_of(twins, "i", "j", "si", "sj") == want
    shares = [r["count"] for r in twins.groupBy(F.spark_partition_id().alias("at")).count().collect()]
    assert max(shares) < 0.6 * len(want)
    named = P.twin_pairs(df, "id", "stem", "source", relation=lambda a, b: F.concat(a, F.lit(">"), b))
    assert rows_of(named, "i", "j", "relation") == [(i, j, f"{s}>{t}") for i, j, s, t in want]
    assert P.twin_pairs(df.limit(0), "id", "stem", "source").count() == 0


def vectors(spark, n=60, d=8, seed=0, shift=3.0):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = rng.normal(size=d)
        rows.append((2 * k, "s", f"t{k}", base.tolist()))
        moved = base + rng.normal(size=d) * 0.05
        moved[0] += shift
        rows.append((2 * k + 1, "t", f"t{k}", moved.tolist()))
    return spark.createDataFrame(rows, "id long, source string, stem string, v array<double>"), rows


def test_nearest_neighbours(spark):
    df, rows = vectors(spark)
    own = V.unit_vectors(df, "id", "v", "source", "stem")
    u = np.array([r[3] for r in rows])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = np.round(np.clip(1 - u @ u.T, 0, 1), 9)
    np.fill_diagonal(d, 9)
    for block in (4096, 17):
        got = {r["i"]: r["j"] for r in V.nearest_neighbours(own, block).collect()}
        assert [got[i] for i in range(len(rows))] == d.argmin(axis=1).tolist()


def test_style_offsets(spark):
    df, _ = vectors(spark, 40)
    twins = P.twin_pairs(df.withColumn("row_idx", F.col("id")), "id", "stem", "source")
    off = {r["source"]: np.array(r["offset"]) for r in V.style_offsets(df, twins, 0.1).collect()}
    assert abs((off["t"] - off["s"])[0] - 3.0) < 0.1 and np.abs((off["t"] - off["s"])[1:]).max() < 0.1
    clean = V.remove_style(df, V.style_offsets(df, twins, 0.1))
    near = {r["i"]: r["j"] for r in V.nearest_neighbours(clean).collect()}
    assert np.mean([near[2 * k] == 2 * k + 1 for k in range(40)]) > 0.95


def test_style_without_twin_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, "abc"[rng.integers(3)], int(rng.integers(4)), None if i % 7 == 0 else rng.normal(size=3).tolist()) for i in range(60)]
    df = spark.createDataFrame([*rows, (90, "d", 9, [1.0, 2.0, 3.0])], "id long, source string, stem long, v array<double>")
    twins, v = P.twin_pairs(df.withColumn("row_idx", F.col("id")), "id", "stem", "source"), df.filter("v is not null")
    counts, sums = V.twin_sums(v, twins)
    got_counts, got_sums = V.stem_sums(df)
    pairs = Counter()
    for r in counts.collect():
        pairs[tuple(sorted((r["si"], r["sj"])))] += r["n"]
    assert {(r["si"], r["sj"]): r["n"] for r in got_counts.collect()} == pairs
    want = {(r["source"], r["k"]): r["x"] for r in sums.collect()}
    assert {(r["source"], r["k"]): r["x"] for r in got_sums.collect()} == pytest.approx(want) and len(want) == 9
    want = {r["source"]: r["offset"] for r in V.style_offsets(v, twins).collect()}
    for r in V.style_offsets_of(df).collect():
        assert r["offset"] == pytest.approx(want[r["source"]])
    # 200,000 rows of one stem have 10^10 twins
    big = spark.range(200_000).select("id", (F.col("id") % 2).cast("string").alias("source"), F.lit(1).alias("stem"), F.array(F.lit(1.0), (F.col("id") % 2).cast("double")).alias("v"))
    off = {r["source"]: r["offset"] for r in V.style_offsets_of(big).collect()}
    assert off["1"] == pytest.approx([0.0, 0.5], abs=1e-6) and off["0"] == pytest.approx([0.0, -0.5], abs=1e-6)


def test_auc_and_cohesion(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 1), rng.random() < 0.4) for _ in range(200)]
    want = np.mean([1.0 if a < b else 0.5 if a == b else 0.0 for a, p in rows if p for b, q in rows if not q])
    assert E.auc(spark.createDataFrame(rows, "d double, twin boolean"), "d", "twin").first()["auc"] == pytest.approx(want)
    df, raw = vectors(spark, 20)
    own = V.unit_vectors(df, "id", "v", "source", "stem")
    u = np.array([r[3] for r in raw])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s, src = u @ u.T, np.array([r[1] for r in raw])
    got = {r["source"]: r["cohesion"] for r in E.group_cohesion(own).collect()}
    for x in ("s", "t"):
        m = src == x
        assert got[x] == pytest.approx(s[np.ix_(m, m)].mean() - s[np.ix_(m, ~m)].mean())
    counts = E.auc_of_counts(V.distance_counts(own, 3, block=7)).first()["auc"]
    pairs = [(round(min(1, max(0, 1 - s[i, j])), 3), raw[i][2] == raw[j][2]) for i in range(len(raw)) for j in range(i) if src[i] != src[j]]
    want = np.mean([1.0 if a < b else 0.5 if a == b else 0.0 for a, p in pairs if p for b, q in pairs if not q])
    assert counts == pytest.approx(want, abs=2e-3)


def test_retrieval_ties(spark):
    rows = [(0, j, 1.0, "s") for j in (1, 2, 3)]
    distances = spark.createDataFrame(rows, "a long, b long, d double, source string")
    twins = spark.createDataFrame([(0, 2)], "a long, b long")
    assert E.retrieval_ranks(distances, twins).first()["rank"] == 2.0


@pytest.mark.parametrize("pool", [True, False])
def test_class_ranks(spark, pool):
    rng = random.Random(8)
    raw = [(i, rng.randrange(2), rng.choice("xy"), rng.choice("abc"), rng.choice((1.0, 1.1, 1.5, 2.25, None))) for i in range(120)]
    rows = spark.createDataFrame(raw, "id long, g int, stem string, source string, value double").repartition(3)
    a, b = rows.select("g", *[F.col(c).alias(f"{c}_a") for c in ("id", "stem", "source", "value")]), rows.select("g", *[F.col(c).alias(f"{c}_b") for c in ("id", "stem", "source", "value")])
    met = a.join(b, "g").filter("id_a <> id_b").withColumn("d", F.round(F.abs(F.col("value_a") - F.col("value_b")), 2))
    wanted = met.filter("stem_a = stem_b and source_a <> source_b").select(F.col("id_a").alias("a"), F.col("id_b").alias("b"))
    plain = E.retrieval_ranks(met.select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "d", F.col("source_b").alias("source")), wanted, "source" if pool else None)
    place = ["g"], "stem", "source", "value"
    ranks = E.class_ranks(rows, *place, pool=pool)
    assert rows_of(E.class_members(rows, ranks, ["g", "stem", "source", "value"]), "a", "b", "rank") == rows_of(plain, "a", "b", "rank")
    assert ranks.count() < plain.count() / 2
    weight = F.col("na") * F.col("nb")
    assert tuple(E.summarise_ranks(ranks, weight=weight).first()) == pytest.approx(tuple(E.summarise_ranks(plain).first()))
    by = lambda df: rows_of(df, "relation", "n", "top1", "median_rank")
    kept = E.class_ranks(rows.withColumn("relation", F.col("id") % 3), *place, pool=pool, keep=("relation",))
    assert by(E.evaluate_ranks(kept, weight=weight)) == [pytest.approx(x) for x in by(E.evaluate_ranks(plain.withColumn("relation", F.col("a") % 3)))]


def places(raw, pool):
    """(a, b): rank of raw(id, group, stem, source, value), from all pairs."""
    def d(a, b):
        if a is None or b is None:
            return None
        x = abs(a - b)
        y = math.floor(x * 100) if math.isfinite(x) else 0
        return math.inf if math.isnan(x) else 1e300 if math.isinf(x) else (y + (x * 100 - y >= 0.5)) / 100

    out = {}
    for i, g, stem, source, v in raw:
        near = [(j, s, d(v, w)) for j, h, _, s, w in raw if h == g and j != i]
        for j, h, other, s, w in raw:
            if h == g and stem is not None and stem == other and None not in (source, s) and s != source:
                t = d(v, w)
                own = [x for _, z, x in near if x is not None and t is not None and (z == s or not pool)]
                out[i, j] = 1 + sum(x < t for x in own) + (sum(x == t for x in own) - 1) / 2
    return out


@pytest.mark.parametrize("values", ["cents", "apart", "odd"])
@pytest.mark.parametrize("pool", [True, False])
def test_twin_ranks_in_parts(spark, monkeypatch, pool, values):
    monkeypatch.setattr(E, "MADE", 100)
    monkeypatch.setattr(E, "RANKED", 100)
    rng = random.Random(9)
    value = {"cents": lambda: rng.randrange(400) / 100, "apart": lambda: rng.random() * 0.3, "odd": lambda: rng.choice((1.0, 0.123, -0.0, 0.0, 1e9, math.nan, math.inf, -math.inf, None))}[values]
    raw = [(i, rng.randrange(2), rng.choice(("x", "y", None)), rng.choice(("a", "b", "c", None)), value()) for i in range(150)]
    rows = spark.createDataFrame(raw, "id long, g int, stem string, source string, value double").repartition(3)
    place, want = (["g"], "stem", "source", "value"), places(raw, pool)
    got = [(r["a"], r["b"], r["rank"]) for r in E.twin_ranks(rows, *place, pool=pool).collect()]
    assert len(got) == len(want) and {(a, b): rank for a, b, rank in got} == want
    counts = E.rank_counts(rows.withColumn("relation", F.col("id") % 3), *place, pool=pool, keep=("relation",))
    assert rows_of(counts.groupBy("relation", "rank").agg(F.sum("n").alias("n")), "relation", "rank", "n") == sorted((k, x, n) for (k, x), n in Counter((a % 3, x) for (a, _), x in want.items()).items())


@pytest.mark.parametrize("cells", [1 << 22, 10])
def test_pool_tables(monkeypatch, cells):
    monkeypatch.setattr(placing, "CELLS", cells)
    rng = np.random.default_rng(4)
    source, value, n = rng.integers(0, 4, 300), rng.integers(-500, 500, 300) / 100, rng.integers(1, 5, 300)
    own = placing.Pool(source, value, n, 2)
    a, k = rng.choice(value, 200), rng.integers(0, 300, 200)
    d = np.round(np.abs(a[:, None] - value[None]), 2)
    t, mine = d[np.arange(200), k][:, None], source[None] == source[k][:, None]
    nearer, near = own.placed(source[k], a, value[k])
    assert own.grid and (nearer == ((d < t) & mine) @ n).all() and (near == ((d == t) & mine) @ n).all()
    assert all((x == y).all() for x, y in zip(own._anywhere(source[k], a, value[k]), (nearer, near), strict=True))


def test_rank_counts_do_not_meet_the_pool(spark):
    """3,000 values in a group: 3.4 million pairs of classes, which with the pool would be ten thousand million rows."""
    n = 3000
    rows = spark.range(n).select("id", F.lit(1).alias("g"), (F.col("id") % 2).alias("stem"), (F.floor(F.col("id") / 2) % 4).alias("source"), (F.col("id") * 7 % n / 10).alias("value"))
    got = {r["rank"]: r["n"] for r in E.rank_counts(rows, ["g"], "stem", "source", "value", pool=False).groupBy("rank").agg(F.sum("n").alias("n")).collect()}
    ids = np.arange(n)
    place, want = ids * 7 % n, Counter()
    for i in range(n):
        d = np.abs(place - place[i])
        upto = np.cumsum(np.bincount(d, minlength=n))  # the row itself included
        twins = d[(ids % 2 == i % 2) & (ids // 2 % 4 != i // 2 % 4)]
        want.update((upto[twins - 1] + (upto[twins] - upto[twins - 1] - 1) / 2).tolist())
    assert got == {k: v for k, v in want.items()} and sum(got.values()) == n * n * 3 // 8


def test_rand_hill_and_summaries(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.randrange(4)) for _ in range(60)]
    same = lambda k: {(i, j) for i, j in itertools.combinations(range(60), 2) if rows[i][k] == rows[j][k]}
    a, b, total = same(0), same(1), 60 * 59 / 2
    want = (len(a & b) - len(a) * len(b) / total) / ((len(a) + len(b)) / 2 - len(a) * len(b) / total)
    df = spark.createDataFrame(rows, "a int, b int")
    assert E.adjusted_rand(df, "a", "b").first()["ari"] == pytest.approx(want)
    assert E.adjusted_rand(df, "a", "a").first()["ari"] == 1.0
    h = E.hill_numbers(spark.createDataFrame([("x",), ("x",), ("y",)], "cluster string")).first()
    assert (h["q0"], h["q1"], h["q2"], h["redundancy"]) == (2.0, pytest.approx(math.exp(-(2 / 3 * math.log(2 / 3) + 1 / 3 * math.log(1 / 3)))), pytest.approx(9 / 5), 1.5)
    assert tuple(E.hill_numbers(df.select(F.col("a").alias("cluster")).limit(0)).first()) == (0.0, 0.0, 0.0, 0.0)
    m = E.h1_summary(spark.createDataFrame([(0.8, 0.7), (0.75, 0.6)], "m0 double, m1 double")).first()
    assert tuple(round(x, 3) for x in m) == (0.775, 0.65, -0.125)
    assert E.accuracy(df.limit(0), "a", "b").first()["accuracy"] == 0.0


def results(spark):
    rows = [(a, t, "c", r, None, a != "bad", 0.1 * (1 + (a == "good"))) for a in ("good", "bad", "control") for t in ("t1", "t2") for r in (0, 1)]
    return spark.createDataFrame([*rows, ("good", "t3", "c", 0, "m2", False, None)], "agent_id string, task_id string, capability string, rep int, requested_model string, passed boolean, cost_usd double")


def test_tournament(spark):
    res = results(spark)
    got = {r["agent_id"]: r for r in G.ranking(res).collect()}
    assert got["good"]["pass_rate"] == 1.0 and got["bad"]["pass_rate"] == 0.0 and got["good"]["runs"] == 5
    assert G.of_model(res, "m1", "m1").count() == 12
    assert rows_of(G.difficulty(res), "task_id") == [("t1",), ("t2",)]
    boot = {r["agent_id"]: r for r in G.bootstrap(G.complete(G.cells(res)), 50).collect()}
    assert (boot["good"]["pass_low"], boot["good"]["rank_low"], boot["bad"]["rank_high"]) == (1.0, 1, 3)
    extra = {r["agent_id"]: r for r in G.paired_cost(res, "control", 50).collect()}
    assert extra["good"]["extra_cost"] == pytest.approx(1.0) and extra["bad"]["low"] == pytest.approx(0.0)
    assert G.ranking(res.limit(0)).count() == 0


def test_behaviour(spark):
    rows = [("a", 0, 0, [1.0, 0.0]), ("a", 0, 1, [1.0, 0.0]), ("b", 0, 0, [0.0, 1.0]), ("b", 1, 0, [1.0, 0.0]), ("c", 1, 0, [1.0, 0.0])]
    ans = spark.createDataFrame(rows, "agent string, probe int, rep int, v array<double>")
    assert rows_of(B.content_distances(ans), "i", "j", "d") == [("a", "b", 1.0), ("b", "c", 0.0)]
    assert B.noise_ceiling(ans).first()["noise"] == 0.0
    prof = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, None])], "agent string, disposition array<double>")
    assert rows_of(B.disposition_distances(prof), "i", "j", "d") == [("a", "b", 1.0)]
    rng = np.random.default_rng(0)
    pairs = [(f"{i:02d}", f"{j:02d}", float(x), float(x)) for (i, j), x in zip(itertools.combinations(range(12), 2), rng.random(66))]
    df = spark.createDataFrame(pairs, "i string, j string, a double, b double")
    assert B.spearman(df).first()["r"] == pytest.approx(1.0)
    m = B.mantel(df, permutations=99).first()
    assert (m["r"], m["n"]) == (1.0, 12) and m["p"] <= 0.05
    other = df.withColumn("b", F.rand(3))
    assert B.mantel(other, permutations=99).first()["p"] > 0.01


def test_partitions_do_not_matter(spark):
    rows = [(i, x) for i, s in random_sets(9, 30) for x in s]
    df = spark.createDataFrame(rows, "id long, item string")
    a = rows_of(P.weighted_set_distances(df, 40).withColumn("d", F.round("d", 9)), "i", "j", "d")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    b = rows_of(P.weighted_set_distances(df.repartition(5), 40).withColumn("d", F.round("d", 9)), "i", "j", "d")
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert a == b
