"""The queries opN_<name> of this subpackage, with production parameters, and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

BLANK = r"[\x20\x09-\x0D]"


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = dedup_lines(docs, min_docs=10, keep="none", min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


SQL5 = r"""
WITH l AS (
  SELECT rowid_ AS r, doc_id, i, line, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT rowid_, doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i
        FROM (SELECT row_number() OVER () AS rowid_, doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents))),
c AS (SELECT k FROM l WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
m AS (SELECT l.*, c.k IS NOT NULL AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r, doc_id
"""

def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_items

    out = find_items(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("hits", lambda x: x["item_id"])))
    return out.select("doc_id", (F.size("hits") > 0).alias("contaminated"), F.size("hits").cast("long").alias("n_hits"), items.alias("item_ids"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2, percent=80)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprints import compare_next

    return compare_next(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import fold, predict, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, fold(4) != 2)
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_records, write_archives

    index, root = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), least=1000)
    return read_records(index, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_rows

    out = shard_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fold, score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), fold(5) != 0)
    out = score(docs, model)
    return out.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import digest, find_secrets

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), pieces=True)  # the SQL allows every path whole
    base = F.filter("secrets", lambda x: x["kind"] < 3)
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("secrets")).alias("spans"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_decontamination": op2_decontamination,
    "op3_near_dedup": op3_near_dedup,
    "op4_fingerprints": op4_fingerprints,
    "op5_line_dedup": op5_line_dedup,
    "op6_language": op6_language,
    "op7_warc": op7_warc,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_secrets": op10_secrets,
}

def _sql10() -> str:
    """Places from a split's pieces and the matches between them; a window's entropy by the engine's own aggregate."""
    # stated here on its own, not read from the operator
    assign, access, hex_ = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", "AKIA[A-Z0-9]{12,}", "[0-9a-f]{32,}"
    candidate, window, least_hex, least_any = "[A-Za-z0-9+/_=-]{20,}", 20, 2.95, 3.62
    no_secret = (
        "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$", "(?i)example|placeholder|changeme|lorem|xxxx|redacted", "(?i)0123456789|abcdefghijkl|qwertyuiop",
        "^[0-9+/_=-]+$", "^[A-Za-z+/_=-]+$", "//|/[^/]*/[^/]*/",
    )

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    def kind(k: int, pattern: str, group: int, least: int) -> str:
        p = quoted(pattern)
        return f"""SELECT r, {k} AS kind, hit, x0 + list_sum(list_transform(pieces[1:i], lambda x: length(x))) AS s FROM (
          SELECT r, i, hits[i] AS hit, parts[i] AS part, pieces, coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS x0
          FROM (SELECT r, hits, parts, pieces, unnest(range(1, len(hits) + 1)) AS i FROM (
            SELECT r, regexp_extract_all(t, {p}) AS hits, regexp_extract_all(t, {p}, {group}) AS parts, string_split_regex(t, {p}) AS pieces FROM d)))
          WHERE length(part) >= {least}"""

    allowed = " ".join(f"AND NOT regexp_matches(hit, {quoted(p)})" for p in no_secret)
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS MATERIALIZED (SELECT r, kind, s::BIGINT AS s, (s + length(hit))::BIGINT AS e FROM ({kind(0, assign, 2, 8)} UNION ALL {kind(1, access, 0, 0)} UNION ALL {kind(2, hex_, 0, 0)})),
cand AS MATERIALIZED (SELECT r, kind, hit, s::BIGINT AS s, (s + length(hit))::BIGINT AS e FROM ({kind(3, candidate, 0, 0)})
         WHERE regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Za-z]') {allowed}),
added AS (SELECT r, kind, s, e FROM cand c WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = c.r AND b.s < c.e AND c.s < b.e)
          AND list_max(list_transform(range(1, length(hit) - {window} + 2), lambda i: list_aggregate(string_split(substr(hit, i, {window}), ''), 'entropy')))
              >= CASE WHEN regexp_matches(hit, '^([0-9a-f]+|[0-9A-F]+)$') THEN {least_hex} ELSE {least_any} END),
every AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || s || ':' || e AS x FROM (SELECT * FROM base UNION ALL SELECT * FROM added))
SELECT any_value(doc_id) AS doc_id, (count(*) FILTER (kind = 0))::BIGINT AS n_assign, (count(*) FILTER (kind = 1))::BIGINT AS n_access,
       (count(*) FILTER (kind = 2))::BIGINT AS n_hex,
       sha256(coalesce(string_agg(x, ',' ORDER BY s, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(x, ',' ORDER BY s, kind), '') AS spans
FROM d LEFT JOIN every USING (r) GROUP BY r"""


SQL7 = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
m AS (SELECT h, max(page_id) AS ref FROM p WHERE n >= 1000 GROUP BY h)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(p.h) AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM coalesce(m.ref, page_id) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM coalesce(m.ref, page_id) THEN m.ref END AS refers_to
FROM p LEFT JOIN m ON p.h = m.h
"""

#: Candidates share one of the rarest members of their sets, as many as make sure that a similar pair does; exact.
SQL3 = r"""
WITH RECURSIVE
d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT r, doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM d),
e AS (SELECT r, len(s) AS n, unnest(s) AS t FROM s),
f AS (SELECT t, count(*) AS c FROM e GROUP BY t),
p AS MATERIALIZED (SELECT r, n, t FROM (SELECT r, n, t, row_number() OVER (PARTITION BY r ORDER BY c, t) AS k FROM e JOIN f USING (t)) WHERE k <= n - ceil(n * 80 / 100.0) + 1),
c AS (SELECT DISTINCT a.r AS a, b.r AS b FROM p a JOIN p b USING (t) WHERE a.r < b.r AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
l AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS n FROM c JOIN s x ON x.r = a JOIN s y ON y.r = b) WHERE 100 * i >= 80 * (n - i)),
u AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(r, o) AS (SELECT r, r FROM s UNION SELECT reach.r, u.b FROM reach JOIN u ON u.a = reach.o),
g AS (SELECT reach.r, min(s.doc_id) AS component_id FROM reach JOIN s ON s.r = reach.o GROUP BY reach.r)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, g.component_id, s.doc_id = g.component_id AS kept FROM s JOIN g USING (r)
"""


ORACLE = {
    "op3_near_dedup": SQL3,
    "op7_warc": SQL7,
    "op10_secrets": _sql10(),
    "op5_line_dedup": SQL5,
}
