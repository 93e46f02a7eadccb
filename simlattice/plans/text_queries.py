"""Queries of the text and record operators over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlattice.functions import answers as A
from simlattice.functions import text as T
from simlattice.operators import records as R
from simlattice.sources.records import latest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: the purpose is the first line, the path the id."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_idx"), F.col("doc_id").cast("string").alias("source_path"), "source", F.split("text", "\n")[0].alias("purpose"), F.col("text").alias("prompt"), "lang"
    )


def first_of_equal(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return R.first_of_equal(docs, "doc_id").select("doc_id", "lang", F.md5("text").alias("digest"))


def dedupe_copies(spark, sf_dir):
    out = R.dedupe_copies(_records(spark, sf_dir))
    return out.select("row_idx", "source", F.coalesce(F.array_join("copies", ","), F.lit("")).alias("copies"))


def assign_ids(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return R.assign_ids(parts, "p_brand", "p_name", "p_partkey").select("p_partkey", "agent_id")


def strip_source_boilerplate(spark, sf_dir):
    out = R.strip_source_boilerplate(table(spark, sf_dir, "documents"), threshold=0.1)
    return out.select("doc_id", F.md5("stripped").alias("digest"))


def strip_lines(spark, sf_dir):
    out = R.strip_lines(table(spark, sf_dir, "documents"), "doc_id", threshold=0.1)
    return out.select("doc_id", F.md5("stripped").alias("digest"))


def token_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.size(T.tokens("text")).cast("long").alias("tokens"), F.size(T.token_set("text")).cast("long").alias("distinct_tokens"), F.size(T.shingles("text")).cast("long").alias("shingles"), F.size(T.chunks("text")).cast("long").alias("chunks"))


def normalised_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.normalise("text")).alias("digest"))


def content_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", T.terms("text").alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("t"), ",")).alias("digest"))


def style_features(spark, sf_dir):
    docs = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.structure_features("text").alias("f"))
    names = ("words", "headings", "fences", "bullets", "numbered", "questions")
    return docs.select("conv_id", "turn", *[F.round(F.element_at("f", k + 1), 6).alias(n) for k, n in enumerate(names)])


def file_stems(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.file_stem("url").alias("stem"))


def record_keys(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.short_hash("url", F.col("page_id").cast("string"), length=32).alias("key"), T.probe_hash("url", F.lit(None).cast("string")).alias("probe"))


def strip_name(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    word = F.element_at(F.split("p_name", " "), 1)
    return parts.select("p_partkey", T.strip_name(F.concat("p_name", F.lit(" "), F.upper("p_name")), word).alias("stripped"))


def prompt_sections(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("agent_id"), F.replace("text", F.lit("\nT"), F.lit("\n# T")).alias("prompt"))
    return R.sections(docs, "agent_id").select("agent_id", "k", F.coalesce("label", F.lit("")).alias("label"), F.md5("content").alias("digest"))


def agent_modules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.lit("").alias("agent_id"), F.col("doc_id").cast("string").alias("source_path"), F.replace("text", F.lit("\nT"), F.lit("\n# T")).alias("prompt"), F.array("lang", "source").alias("tools"))
    return R.modules(docs).groupBy("agent_id", "kind").agg(F.count("*").alias("modules"), F.min("module_id").alias("first_id"))


def _families(spark, sf_dir):
    return R.families(table(spark, sf_dir, "part"), "p_brand", "p_name")


def copy_debt(spark, sf_dir):
    return R.copy_debt(_families(spark, sf_dir), 3)


def pan_genome(spark, sf_dir):
    return R.pan_genome(_families(spark, sf_dir)).select("member", F.array_join("families", ",").alias("families"))


def shared_needs(spark, sf_dir):
    pairs = table(spark, sf_dir, "events").select(F.col("event_type").alias("family"), F.col("user_id").alias("member"))
    clusters = pairs.select((F.col("member") % 7).alias("cluster"), "member").filter("member % 3 = 0").distinct()
    return R.shared_needs(pairs, clusters)


def transfer_candidates(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    fams = parts.select(F.col("p_type").alias("family"), F.col("p_brand").alias("member"))
    size = parts.groupBy(F.col("p_brand").alias("m")).agg(F.avg("p_size").alias("s"))
    met = size.select(F.col("m").alias("a"), F.col("s").alias("sa")).join(size.select(F.col("m").alias("b"), F.col("s").alias("sb")), F.col("a") < F.col("b"))  # brands: a fixed number
    gap = met.select("a", "b", (F.abs(F.col("sa") - F.col("sb")) / 10).alias("d"))
    return R.transfer_candidates(fams, gap, gap.withColumn("d", 1 - F.col("d"))).select("a", "b", F.size("shared").cast("long").alias("shared"))


def _brand_scores(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    by = parts.groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    a, b = by.select("p_type", F.col("p_brand").alias("a"), F.col("n").alias("na")), by.select("p_type", F.col("p_brand").alias("b"), F.col("n").alias("nb"))
    scores = a.join(b, "p_type").filter("a < b").groupBy("a", "b").agg((F.sum(F.least("na", "nb")) / F.sum(F.greatest("na", "nb"))).alias("score"))
    wanted = by.select(F.col("p_brand").alias("b")).distinct().join(by.select(F.col("p_brand").alias("a")).distinct(), F.col("a") != F.col("b"))  # brands: a fixed number
    return wanted.select("a", "b"), scores


def merge_candidates(spark, sf_dir):
    wanted, scores = _brand_scores(spark, sf_dir)
    return R.merge_candidates(wanted, scores, 0.3).select("a", "b", F.round("score", 6).alias("score"))


def drift_pairs(spark, sf_dir):
    wanted, scores = _brand_scores(spark, sf_dir)
    return R.drift_pairs(wanted, scores.withColumn("score", 1 - F.col("score")), 0.2).select("a", "b", F.round("score", 6).alias("score"))


def todo_requests(spark, sf_dir):
    requests = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"))
    store = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("key"))
    return R.todo(requests, store)


def latest_by_key(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), "event_type")
    return latest(events).select("key", "seq", "event_type")


def in_flight(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "collected").otherwise("submitted")
    log = events.select(F.col("event_id").alias("seq"), (F.col("user_id") % 3).alias("phase"), kind.alias("event"), F.array("user_id", F.col("user_id") + 1).alias("keys"))
    return R.in_flight(log)


def to_judge(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus")
    judged = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("key")).distinct()
    flying = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O'").select(F.col("l_orderkey").alias("key")).distinct()
    return R.to_judge(own, judged, flying)


def request_grid(spark, sf_dir):
    agents = table(spark, sf_dir, "nation").select(F.col("n_name").alias("agent_id"))
    probes = table(spark, sf_dir, "region").select(F.col("r_name").alias("id"))
    return R.request_grid(agents, probes, 2, "baseline")


def plan_cost(spark, sf_dir):
    agents = table(spark, sf_dir, "conversations").filter("role = 'system'").select(F.col("text").alias("system"))
    probes = table(spark, sf_dir, "benchmark").select(F.col("text").alias("prompt"))
    return R.estimate_cost(agents, probes, 2)


def task_reasons(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    tasks = docs.select(
        "doc_id", F.when(F.col("lang") == "en", "verifiable").otherwise("open").alias("type"), F.when(F.col("n_chars") > 500, F.col("text")).alias("prompt"), F.col("text").alias("buggy_code"), F.when(F.col("quality") == 1, F.lit("test")).alias("test_code"), F.lit("x").alias("reference_code"),
        (F.col("toxic") == 0).alias("reference_passes"), (F.col("quality") == 0).alias("buggy_passes"), F.when(F.col("lang") == "fr", F.array("source")).alias("rubric"),
    )
    return R.validate_tasks(tasks).select("doc_id", "valid", F.array_join("reasons", ",").alias("reasons"))


def task_tally(spark, sf_dir):
    from simlattice.operators.tournament import task_tally as tally

    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return tally(docs.select(F.col("lang").alias("type"), (F.col("quality") == 1).alias("valid")))


def rescored(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("k"), F.min("l_returnflag").alias("f"))
    results = own.select(F.col("l_orderkey").alias("key"), (F.col("f") == "A").alias("passed"), F.when(F.col("k") > 3, F.lit(2)).alias("scorer_version"), F.when(F.col("k") != 2, F.lit("x")).alias("answer"))
    verdicts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), (F.col("o_orderstatus") == "F").alias("passed"))
    return R.rescore(results, verdicts).select("key", "passed", "passed_before", "scorer_version")


def source_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("agent_id"), "source", F.col("text").alias("prompt"))
    stem = F.concat(F.lit("s"), F.col("agent_id").cast("long") % 400)
    return R.sample_sources(docs, "src0", stem, 20).select("agent_id", "source")


def wilson_interval(spark, sf_dir):
    own = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") != "R").alias("passed"), F.count("*").alias("n"))
    return own.withColumn("w", T.wilson(F.col("passed"), F.col("n"))).select("l_suppkey", "passed", "n", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"))


def _answers(spark, sf_dir):
    """Documents as answers: a fix in Python, a test in a block of its own, the text in the document's language, and an open block."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.translate(F.coalesce("text", F.lit("")), "\r\f\x0b\x85\u2028\u2029", "").alias("text"))
    fix = F.format_string("def f_%d():\n    return 1\nX = Y = %d", F.col("doc_id"), F.col("doc_id"))
    test = F.format_string("def test_f_%d():\n    assert f_%d()", F.col("doc_id"), F.col("doc_id"))
    answer = F.concat(F.lit("I say\n````python\n"), fix, F.lit("\n```\n~~~\n"), test, F.lit("\n~~~~\n``` "), F.upper("lang"), F.lit(" \n"), F.col("text"), F.lit("\n```\n```\nopen"))
    return docs.select("doc_id", fix.alias("fix"), answer.alias("answer"))


def code_blocks(spark, sf_dir):
    out = _answers(spark, sf_dir).select("doc_id", F.posexplode(A.code_blocks("answer")).alias("k", "b"))
    return out.select("doc_id", "k", F.col("b.lang").alias("lang"), F.md5("b.code").alias("digest"))


def top_level_names(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", F.array_join(A.top_level_names("fix"), ",").alias("names"))


def extracted_code(spark, sf_dir):
    return _answers(spark, sf_dir).select("doc_id", A.extract_code("answer", "fix").alias("code"), F.md5(A.extract_code("answer")).alias("last"))


def extracted_files(spark, sf_dir):
    files = F.create_map(F.lit("other.py"), F.lit("Z = 1"), F.lit("fix.py"), F.col("fix"))
    out = _answers(spark, sf_dir).withColumn("files", files).select("doc_id", A.extract_files("answer", "files").alias("changed"))
    return out.select("doc_id", F.explode_outer("changed").alias("file", "code")).filter("file is not null")


QUERIES = {f.__name__: f for f in (
    first_of_equal, dedupe_copies, assign_ids, strip_source_boilerplate, strip_lines, token_counts, normalised_text, content_terms, style_features, file_stems, record_keys, strip_name,
    prompt_sections, agent_modules, copy_debt, pan_genome, shared_needs, transfer_candidates, merge_candidates, drift_pairs, todo_requests, latest_by_key, in_flight, to_judge, request_grid,
    plan_cost, task_reasons, task_tally, rescored, source_sample, wilson_interval, code_blocks, top_level_names, extracted_code, extracted_files,
)}

_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOPWORDS)
_NORM = "regexp_replace(lower(text), '[^\\p{L}\\p{N}+#.]', ' ', 'g')"
_WORDS = f"list_filter(list_transform(string_split({_NORM}, ' '), lambda w: regexp_replace(w, '\\.+$', '')), lambda w: w <> '')"
_LINES = r"(CASE WHEN list_extract(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), -1) = '' THEN list_slice(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'), 1, -2) ELSE string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') END)"
_TOKENS = r"list_filter(string_split_regex(lower(text), '\s+'), lambda w: w <> '')"
_BLOCKS = f"""
r AS (SELECT doc_id, list_filter(string_split(replace(text, chr(10) || 'T', chr(10) || '# T'), chr(10)), lambda x: trim(x) <> '') AS l FROM documents),
e AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM r)),
s AS (SELECT *, sum(CASE WHEN i = 1 OR ltrim(line)[1] = '#' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k FROM e),
blocks AS (SELECT doc_id::VARCHAR AS agent_id, k::INTEGER AS k, string_agg(line, chr(10) ORDER BY i) AS content FROM s GROUP BY doc_id, k)"""
_FIX = "'def f_' || doc_id || '():' || chr(10) || '    return 1' || chr(10) || 'X = Y = ' || doc_id"
_TEST = "'def test_f_' || doc_id || '():' || chr(10) || '    assert f_' || doc_id || '()'"
_SCORES = """
n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2),
sc AS (SELECT a.p_brand AS a, b.p_brand AS b, sum(least(a.n, b.n))::DOUBLE / sum(greatest(a.n, b.n)) AS score FROM n a JOIN n b USING (p_type) WHERE a.p_brand < b.p_brand GROUP BY 1, 2),
br AS (SELECT DISTINCT p_brand FROM part),
w AS (SELECT x.p_brand AS a, y.p_brand AS b FROM br x, br y WHERE x.p_brand <> y.p_brand)"""

ORACLE = {
    "code_blocks": f"""SELECT doc_id, 0 AS k, 'python' AS lang, md5({_FIX}) AS digest FROM documents UNION ALL SELECT doc_id, 1, '', md5({_TEST}) FROM documents
        UNION ALL SELECT doc_id, 2, lower(coalesce(lang, '')), md5(regexp_replace(coalesce(text, ''), '[\\r\\f\\x0b\\x{{85}}\\x{{2028}}\\x{{2029}}]', '', 'g')) FROM documents""",
    "top_level_names": "SELECT doc_id, 'X,Y,f_' || doc_id AS names FROM documents",
    "extracted_code": f"SELECT doc_id, {_FIX} AS code, md5({_TEST}) AS last FROM documents",
    "extracted_files": f"SELECT doc_id, 'fix.py' AS file, {_FIX} AS code FROM documents",
    "first_of_equal": "SELECT min(doc_id) AS doc_id, lang, md5(text) AS digest FROM documents GROUP BY text, lang",
    "dedupe_copies": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents)
        SELECT min(doc_id) AS row_idx, min_by(source, doc_id) AS source, coalesce(string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (n > 1), '') AS copies FROM p GROUP BY text""",
    "assign_ids": """WITH b AS (SELECT p_partkey, translate(p_brand || '/' || p_name, ' ():;,''[]', '_________') AS base FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) AS k FROM b)
        SELECT p_partkey, CASE WHEN k > 1 THEN base || '~' || k ELSE base END AS agent_id FROM n""",
    "strip_source_boilerplate": f"""WITH x AS (SELECT doc_id, source, {_LINES} AS l FROM documents), e AS (SELECT doc_id, source, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM x),
        k AS (SELECT *, lower(trim(line)) AS key FROM e WHERE trim(line) <> ''), n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
        o AS (SELECT k.source, key FROM k JOIN n USING (source) GROUP BY 1, 2 HAVING count(DISTINCT doc_id) > greatest(any_value(n) * 0.1, 2)),
        g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM k ANTI JOIN o ON k.source = o.source AND k.key = o.key GROUP BY 1)
        SELECT doc_id, md5(coalesce(t, '')) AS digest FROM documents LEFT JOIN g USING (doc_id)""",
    "strip_lines": f"""WITH x AS (SELECT doc_id, {_LINES} AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM x),
        c AS (SELECT *, trim(line) = '' AS blank, count(*) FILTER (trim(line) <> '') OVER (PARTITION BY doc_id) AS n, count(*) OVER (PARTITION BY doc_id, trim(line)) AS k FROM e),
        g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM c WHERE blank OR k <= 0.1 * n GROUP BY 1) SELECT doc_id, md5(coalesce(t, '')) AS digest FROM documents LEFT JOIN g USING (doc_id)""",
    "token_counts": f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents)
        SELECT doc_id, len(w)::BIGINT AS tokens, len(list_distinct(w))::BIGINT AS distinct_tokens, len(list_distinct(list_transform(range(0, greatest(len(w) - 5, 0) + 1), lambda i: array_to_string(w[i + 1:i + 5], ' '))))::BIGINT AS shingles, ceil(len(w) / 150.0)::BIGINT AS chunks FROM t""",
    "normalised_text": f"SELECT doc_id, md5(' ' || array_to_string({_WORDS}, ' ') || ' ') AS digest FROM documents",
    "content_terms": f"""WITH t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        c AS (SELECT doc_id, w, list_filter(w, lambda x: length(x) >= 3 AND NOT list_contains([{_STOP}], x) AND NOT regexp_full_match(x, '\\p{{N}}+')) AS u FROM t),
        a AS (SELECT doc_id, list_distinct(list_concat(u, list_transform(list_filter(range(1, len(w)), lambda i: list_contains(u, w[i]) AND list_contains(u, w[i + 1])), lambda i: w[i] || ' ' || w[i + 1]))) AS t FROM c)
        SELECT doc_id, len(t)::BIGINT AS n, md5(array_to_string(list_sort(t), ',')) AS digest FROM a""",
    "style_features": f"""WITH x AS (SELECT conv_id, turn, text, list_transform({_LINES}, lambda r: ltrim(r)) AS l FROM conversations)
        SELECT conv_id, turn, round(ln(1 + len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''))), 6) AS words,
        len(list_filter(l, lambda r: starts_with(r, '#')))::DOUBLE AS headings, floor((length(text) - length(replace(text, '```', ''))) / 3 / 2)::DOUBLE AS fences,
        len(list_filter(l, lambda r: starts_with(r, '- ') OR starts_with(r, '* ')))::DOUBLE AS bullets, len(list_filter(l, lambda r: regexp_matches(r, '^[0-9]\\.(\\.|$)')))::DOUBLE AS numbered,
        (length(text) - length(replace(text, '?', '')))::DOUBLE AS questions FROM x""",
    "file_stems": r"SELECT page_id, lower(regexp_replace(regexp_extract(url, '([^/]+)/*$', 1), '^(.+)\.[^.]*$', '\1')) AS stem FROM pages",
    "record_keys": "SELECT page_id, substr(sha256(url || '|' || page_id), 1, 32) AS key, substr(sha256(url || chr(10) || 'None'), 1, 16) AS probe FROM pages",
    "strip_name": """SELECT p_partkey, replace(replace(p_name || ' ' || upper(p_name), string_split(p_name, ' ')[1], ' '), lower(string_split(p_name, ' ')[1]), ' ') AS stripped FROM part""",
    "prompt_sections": f"WITH {_BLOCKS} SELECT agent_id, k, CASE WHEN trim(string_split(content, chr(10))[1])[1] = '#' THEN trim(regexp_replace(trim(string_split(content, chr(10))[1]), '^#+', '')) ELSE '' END AS label, md5(content) AS digest FROM blocks",
    "agent_modules": f"""WITH {_BLOCKS}, m AS (SELECT agent_id, 'prompt' AS kind, agent_id || ':prompt:' || k AS module_id FROM blocks UNION ALL SELECT doc_id::VARCHAR, 'tool', doc_id || ':tool:' || i FROM documents, (VALUES (0), (1)) v(i))
        SELECT agent_id, kind, count(*)::BIGINT AS modules, min(module_id) AS first_id FROM m GROUP BY 1, 2""",
    "copy_debt": "SELECT lower(trim(p_name)) AS family, count(*)::BIGINT AS members FROM part GROUP BY 1 HAVING count(*) >= 3",
    "pan_genome": "SELECT p_brand AS member, array_to_string(list_sort(list_distinct(list(lower(trim(p_name))))), ',') AS families FROM part GROUP BY 1",
    "shared_needs": "SELECT event_type AS family, count(DISTINCT CASE WHEN user_id % 3 = 0 THEN user_id % 7 END)::BIGINT AS clusters FROM events GROUP BY 1",
    "transfer_candidates": """WITH f AS (SELECT DISTINCT p_type, p_brand FROM part), s AS (SELECT p_brand, avg(p_size) AS s FROM part GROUP BY 1),
        m AS (SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS shared FROM f x JOIN f y USING (p_type) WHERE x.p_brand < y.p_brand GROUP BY 1, 2)
        SELECT a, b, shared::BIGINT AS shared FROM m JOIN s sa ON sa.p_brand = a JOIN s sb ON sb.p_brand = b WHERE abs(sa.s - sb.s) / 10 < 0.3 AND 1 - abs(sa.s - sb.s) / 10 > 0.5""",
    "merge_candidates": f"WITH {_SCORES} SELECT w.a, w.b, round(coalesce(x.score, y.score, 0), 6) AS score FROM w LEFT JOIN sc x ON x.a = w.a AND x.b = w.b LEFT JOIN sc y ON y.a = w.b AND y.b = w.a WHERE coalesce(x.score, y.score, 0) >= 0.3",
    "drift_pairs": f"WITH {_SCORES} SELECT w.a, w.b, round(coalesce(1 - x.score, 1 - y.score, 0), 6) AS score FROM w LEFT JOIN sc x ON x.a = w.a AND x.b = w.b LEFT JOIN sc y ON y.a = w.b AND y.b = w.a WHERE coalesce(1 - x.score, 1 - y.score, 0) >= 0.2",
    "todo_requests": "SELECT DISTINCT l_orderkey AS key FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "latest_by_key": "SELECT user_id AS key, max(event_id) AS seq, max_by(event_type, event_id) AS event_type FROM events GROUP BY 1",
    "in_flight": """WITH l AS (SELECT event_id, user_id % 3 AS phase, CASE WHEN event_type = 'purchase' THEN 'collected' ELSE 'submitted' END AS e, unnest([user_id, user_id + 1]) AS key FROM events)
        SELECT phase, key FROM l GROUP BY 1, 2 HAVING max_by(e, event_id) = 'submitted'""",
    "to_judge": "SELECT o_orderkey AS key, o_orderstatus FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND (l_returnflag = 'A' OR l_linestatus = 'O'))",
    "request_grid": "WITH a AS (SELECT n_name AS agent_id FROM nation UNION ALL SELECT 'baseline') SELECT agent_id, r_name AS probe_id, rep FROM a, region, (VALUES (0), (1)) v(rep)",
    "plan_cost": """WITH a AS (SELECT count(*) AS na, sum(length(text)) AS ca FROM conversations WHERE role = 'system'), p AS (SELECT count(*) AS np, sum(length(text)) AS cp FROM benchmark),
        c AS (SELECT (na * np * 2)::BIGINT AS calls, ((ca * np + cp * na) / 4.0 + na * np * 50) * 2 AS tin FROM a, p),
        d AS (SELECT calls, (tin * 4 + calls * 1200 * 20) / 1e6 AS r, (calls * 1800 * 4 + calls * 400 * 20) / 1e6 AS j FROM c) SELECT calls, round(r, 2) AS respond_usd, round(j, 2) AS judge_usd, round(r + j, 2) AS total_usd FROM d""",
    "task_reasons": """WITH t AS (SELECT d.doc_id, lang, quality, toxic, CASE WHEN n_chars > 500 THEN text ELSE '' END AS p, text FROM documents d LEFT JOIN labels l USING (doc_id)),
        r AS (SELECT doc_id, list_filter([CASE WHEN trim(p) = '' THEN 'no prompt' END, CASE WHEN lang = 'en' AND trim(text) = '' THEN 'no buggy code' END, CASE WHEN lang = 'en' AND coalesce(quality, 0) <> 1 THEN 'no test code' END,
          CASE WHEN lang = 'en' AND coalesce(toxic, 0) <> 0 THEN 'reference fails' END, CASE WHEN lang = 'en' AND coalesce(quality, 1) = 0 THEN 'buggy code passes' END, CASE WHEN lang <> 'en' AND lang <> 'fr' THEN 'no rubric' END], lambda x: x IS NOT NULL) AS x FROM t)
        SELECT doc_id, len(x) = 0 AS valid, array_to_string(x, ',') AS reasons FROM r""",
    "task_tally": "SELECT lang AS type, count(*)::BIGINT AS total, (count(*) FILTER (quality = 1))::BIGINT AS valid, (count(*) FILTER (quality <> 1))::BIGINT AS invalid FROM documents JOIN labels USING (doc_id) GROUP BY 1",
    "rescored": """WITH r AS (SELECT l_orderkey AS key, min(l_returnflag) = 'A' AS passed, CASE WHEN max(l_linenumber) > 3 THEN 2 END AS v, max(l_linenumber) <> 2 AS answered FROM lineitem GROUP BY 1),
        s AS (SELECT r.*, o_orderstatus = 'F' AS new, coalesce(v, 1) < 2 AND answered AND o_orderkey IS NOT NULL AS stale FROM r LEFT JOIN orders ON o_orderkey = key)
        SELECT key, CASE WHEN stale THEN new ELSE passed END AS passed, CASE WHEN stale THEN passed END AS passed_before, CASE WHEN stale THEN 2 ELSE v END AS scorer_version FROM s""",
    "source_sample": r"""WITH d AS (SELECT doc_id::VARCHAR AS agent_id, source, doc_id % 400 AS stem, md5('7|' || doc_id) AS o FROM documents WHERE source = 'src0' AND len(string_split(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), ' ')) >= 150),
        f AS (SELECT stem, min_by(agent_id, o) AS agent_id, min(o) AS o, any_value(source) AS source FROM d GROUP BY 1) SELECT agent_id, source FROM f ORDER BY o LIMIT 20""",
    "wilson_interval": """WITH n AS (SELECT l_suppkey, count(*) FILTER (l_returnflag <> 'R') AS passed, count(*) AS n FROM lineitem GROUP BY 1), q AS (SELECT *, passed::DOUBLE / n AS p, 1.96 * 1.96 AS z FROM n),
        w AS (SELECT *, (p + z / (2 * n)) / (1 + z / n) AS c, 1.96 / (1 + z / n) * sqrt(p * (1 - p) / n + z / (4.0 * n * n)) AS h FROM q)
        SELECT l_suppkey, passed::BIGINT AS passed, n::BIGINT AS n, round(greatest(0, c - h), 6) AS low, round(least(1, c + h), 6) AS high FROM w""",
}
