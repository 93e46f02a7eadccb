"""Readers of agent definitions in several formats, of probes and taxonomies, and of keyed logs; writers of results.

Every reader gives the columns of schema.RECORD. Files are read by Spark, so any path that it knows will do; text that is no plain
JSON is parsed in Arrow batches.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath
from urllib.parse import unquote

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from simlattice.functions.text import probe_hash
from simlattice.schema import PROBE, RECORD

#: Markdown files that define no agent, in lower case: fixed values.
SKIPPED_NAMES = ("readme.md", "claude.md", "skill.md", "contributing.md", "license.md", "changelog.md")
_FIELDS = ("name", "description", "purpose", "tools", "model")


def _record(**own: object) -> dict:
    base = {"source": "", "source_path": "", "name": "", "purpose": "", "prompt": "", "model": None, "framework": "", "metadata": {}}
    lists = {"tools": [], "data_sources": [], "permissions": [], "input_modes": [], "output_modes": []}
    made = base | lists | own
    made["metadata"] = json.dumps(made["metadata"], sort_keys=True, default=str)
    return made


def split_frontmatter(text: str) -> tuple[dict, str]:
    """The leading `---` block as a mapping, and the body. Without an end, or if it is no mapping, there are no fields."""
    head, found, body = text.partition("\n---\n")
    if not text.startswith("---\n") or not found:
        return {}, text
    import yaml

    try:
        fields = yaml.safe_load(head[4:])
    except yaml.YAMLError:
        fields = loose_fields(head[4:])
    return (fields if isinstance(fields, dict) else {}), body


def loose_fields(head: str) -> dict[str, str]:
    """`key: value` lines that are not indented and have a key of one word; the last of equal keys counts."""
    pairs = (line.partition(":") for line in head.splitlines() if not line[:1].isspace())
    return {key.strip(): value.strip() for key, colon, value in pairs if colon and key.strip() and " " not in key.strip()}


def _stem(path: str) -> str:
    return PurePosixPath(path).stem


def parse_markdown(path: str, text: str, source: str) -> dict:
    fields, body = split_frontmatter(text)
    tools = fields.get("tools") or []
    if isinstance(tools, str):
        tools = [x.strip() for x in tools.split(",") if x.strip()]
    return _record(
        source=source,
        source_path=path,
        name=str(fields.get("name") or _stem(path)),
        purpose=str(fields.get("description") or fields.get("purpose") or ""),
        prompt=body.strip() or text.strip(),
        tools=[str(x) for x in tools] if isinstance(tools, list) else [],
        model=None if fields.get("model") is None else str(fields["model"]),
        framework="claude-code",
        metadata={k: v for k, v in fields.items() if k not in _FIELDS},
    )


def parse_toml(path: str, text: str, source: str) -> dict:
    fields = tomllib.loads(text)
    model = fields.get("model")
    return _record(
        source=source,
        source_path=path,
        name=str(fields.get("name") or _stem(path)),
        purpose=str(fields.get("description") or ""),
        prompt=str(fields.get("developer_instructions") or "").strip(),
        model=None if model is None else str(model),
        framework="codex",
        metadata={k: v for k, v in fields.items() if k not in ("name", "description", "developer_instructions", "model")},
    )


def parse_gpt(path: str, text: str, source: str) -> dict:
    given = json.loads(text)
    if isinstance(given, list):
        given = given[0] if given else {}
    model = given.get("model")
    return _record(
        source=source,
        source_path=path,
        name=str(given.get("name") or given.get("title") or ""),
        purpose=str(given.get("description") or given.get("purpose") or ""),
        prompt=str(given.get("instructions") or given.get("prompt") or ""),
        tools=[str(x) for x in given.get("tools") or given.get("tool_flags") or []],
        model=None if model is None else str(model),
        framework="gpt",
        metadata=given,
    )


def parse_card(path: str, text: str, source: str) -> dict:
    """An agent card: its skills' names are the tools."""
    given = json.loads(text)
    return _record(
        source=source,
        source_path=path,
        name=str(given.get("name") or ""),
        purpose=str(given.get("description") or ""),
        prompt=str(given.get("description") or ""),
        tools=[str(x.get("name") or x) for x in given.get("skills") or []],
        framework="a2a",
        metadata=given,
    )


def parse_workflow(path: str, text: str, source: str) -> dict:
    """A workflow: its nodes' types, or else names, are the tools; repeats stay."""
    given = json.loads(text)
    tools = [str(x.get("type") or x.get("name") or "") for x in given.get("nodes") or []]
    return _record(
        source=source,
        source_path=path,
        name=str(given.get("name") or "workflow"),
        purpose=str(given.get("description") or ""),
        prompt=str(given.get("description") or ""),
        tools=[x for x in tools if x],
        framework="n8n",
        metadata=given,
    )


PARSERS: dict[str, Callable[[str, str, str], dict]] = {"markdown": parse_markdown, "toml": parse_toml, "gpt": parse_gpt, "card": parse_card, "workflow": parse_workflow}


def _files(spark: SparkSession, paths: str | list[str], pattern: str) -> DataFrame:
    """(path, text) of whole files; a missing path has none."""
    try:
        read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(paths, wholetext=True)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, text string")
    return read.select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def _parsed(files: DataFrame, kind: Column, source: Column, skip_errors: bool) -> DataFrame:
    names = [x.split()[0] for x in RECORD.replace("array<string>", "array").split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, text, how, own in zip(batch.path, batch.text, batch.kind, batch.source, strict=True):
                plain = unquote(path).removeprefix("file://")
                try:
                    rows.append(PARSERS[how](plain, text, own))
                except Exception:  # noqa: BLE001  a file that does not parse is left out where asked
                    if not skip_errors:
                        raise
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "text", kind.alias("kind"), source.alias("source")).mapInPandas(run, RECORD)


def indexed(records: DataFrame) -> DataFrame:
    """Adds row_idx: the place by path. It is a rank over paths, found by range partitions, and ends every tie."""
    ordered = records.orderBy("source_path", "name")
    schema = ordered.schema.add("row_idx", "long")
    return records.sparkSession.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (*x[0], x[1])), schema)


def read_records(spark: SparkSession, paths: str | list[str], how: str, source: str | None = None, pattern: str | None = None) -> DataFrame:
    """Definitions of one format: markdown, toml, gpt, card or workflow."""
    glob = pattern or {"markdown": "*.md", "toml": "*.toml"}.get(how, "*.json")
    default = {"markdown": "claude-subagents", "toml": "codex-subagents", "gpt": "gptzoo", "card": "a2a-registry", "workflow": "n8n"}[how]
    return _parsed(_files(spark, paths, glob), F.lit(how), F.lit(source or default), False)


def read_directories(spark: SparkSession, roots: list[str]) -> DataFrame:
    """Definitions below each root; the root's name is the source.

    Markdown files but those of SKIPPED_NAMES, and TOML files with developer instructions. If any file of a root lies in an `agents`
    folder, only such files count. Files that do not parse, and records without a purpose, are left out.
    """
    parts = []
    for root in roots:
        base = root.rstrip("/")
        name = PurePosixPath(base).name
        files = _files(spark, base, "*.md").withColumn("kind", F.lit("markdown")).unionByName(_files(spark, base, "*.toml").filter(F.col("text").contains("developer_instructions")).withColumn("kind", F.lit("toml")))
        file = F.lower(F.element_at(F.split("path", "/"), -1))
        files = files.filter(~file.isin(*SKIPPED_NAMES)).withColumn("below", F.element_at(F.split("path", "/" + name + "/", 2), -1))
        files = files.withColumn("agents", F.array_contains(F.slice(F.split("below", "/"), 1, F.size(F.split("below", "/")) - 1), "agents"))
        flags = files.groupBy().agg(F.coalesce(F.max("agents"), F.lit(False)).alias("any_agents"))
        files = files.crossJoin(F.broadcast(flags)).filter(F.col("agents") | ~F.col("any_agents"))  # one row of flags
        parts.append(_parsed(files, F.col("kind"), F.lit(name), True))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.trim("purpose") != "")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One object a line, blank lines skipped; a missing path has no rows."""
    try:
        return spark.read.schema(schema).json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line with sorted keys."""
    df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def append_log(df: DataFrame, path: str) -> None:
    write_jsonl(df, path, "append")


def latest(log: DataFrame, key: str = "key", order: str = "seq") -> DataFrame:
    """The last row of each key in an append-only log."""
    place = Window.partitionBy(key).orderBy(F.desc(order))
    return log.withColumn("_n", F.row_number().over(place)).filter("_n = 1").drop("_n")


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """A battery of probes from YAML, with a hash of prompt and planted issue."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    given = (yaml.safe_load(text) or {}).get("probes") or []
    rows = [(str(p["id"]), str(p.get("group") or ""), p.get("planted"), str(p["prompt"])) for p in given]
    return spark.createDataFrame(rows, "id string, grp string, planted string, prompt string").withColumn("hash", probe_hash("prompt", "planted")).to(spark.createDataFrame([], PROBE).schema)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(category, trait, phrase, place) from YAML, in the file's order."""
    import yaml

    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())  # one small file
    rows = [(c, t, p) for c, traits in (yaml.safe_load(text) or {}).get("categories", {}).items() for t, phrases in traits.items() for p in phrases]
    return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "category string, trait string, phrase string, place int")


def synthetic(spark: SparkSession, roles: int = 20, per_role: int = 10) -> DataFrame:
    """per_role agents for each of so many roles; they differ in their tools by turns."""
    n = spark.range(roles * per_role).select((F.col("id") / per_role).cast("long").alias("role"), (F.col("id") % per_role).alias("k"), F.col("id").alias("row_idx"))
    tools = F.when(F.col("k") % 2 == 0, F.array(F.lit("read"), F.lit("write"))).otherwise(F.array(F.lit("read"), F.lit("grep")))
    role = F.concat(F.lit("role-"), F.col("role"))
    return n.select("row_idx", F.concat(role, F.lit("-agent-"), F.col("k")).alias("agent_id"), role.alias("role"), role.alias("purpose"), tools.alias("tools"))
