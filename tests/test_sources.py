"""Readers, writers, streams, reports, the command line and the flagship chain."""

import json

import pytest
from pyspark.sql import functions as F

from simlattice import cli
from simlattice.operators import evaluate as E
from simlattice.plans import estate
from simlattice.schema import RECORD, RESULT
from simlattice.sources import records as S
from simlattice.sources import report
from simlattice.streaming import store


def write(folder, **files):
    for name, text in files.items():
        at = folder / name.replace("__", "/")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text, encoding="utf-8")


MARKDOWN = "---\nname: code-reviewer\ndescription: Reviews code\ntools:\n  - read_file\n  - grep\nmodel: big\nextra: 1\n---\nYou review code.\n"


def test_markdown():
    r = S.parse_markdown("/x/file.md", MARKDOWN, "s")
    assert (r["name"], r["purpose"], r["tools"], r["model"], r["prompt"], json.loads(r["metadata"])) == ("code-reviewer", "Reviews code", ["read_file", "grep"], "big", "You review code.", {"extra": 1})
    loose = S.parse_markdown("/x/ui.md", "---\nname: ui\ndescription: Use this: for: UI\ntools: Read, Write\n  indented: no\ntwo words: no\n---\n", "s")
    assert (loose["name"], loose["tools"], loose["purpose"]) == ("ui", ["Read", "Write"], "Use this: for: UI")
    assert loose["prompt"].startswith("---")  # an empty body: the whole text
    assert S.split_frontmatter("---\nname: x\nno end") == ({}, "---\nname: x\nno end")
    assert S.split_frontmatter("---\n- a\n---\nbody") == ({}, "body")
    assert S.parse_markdown("/a/b/Stem.md", "plain", "s")["name"] == "Stem"


def test_other_formats():
    toml = S.parse_toml("/x/a.toml", 'name = "n"\ndescription = "d"\ndeveloper_instructions = """\n do \n"""\n', "s")
    assert (toml["prompt"], toml["framework"], toml["tools"]) == ("do", "codex", [])
    gpt = S.parse_gpt("p", json.dumps([{"title": "t", "purpose": "u", "tool_flags": ["a"], "prompt": "x"}, {}]), "s")
    assert (gpt["name"], gpt["purpose"], gpt["tools"], gpt["prompt"]) == ("t", "u", ["a"], "x")
    assert S.parse_gpt("p", "[]", "s")["name"] == ""
    assert S.parse_card("p", '{"name": "n", "description": "d", "skills": [{"name": "k"}]}', "s")["tools"] == ["k"]
    flow = S.parse_workflow("p", '{"nodes": [{"type": "t"}, {"name": "n"}, {"type": "t"}, {}]}', "s")
    assert (flow["name"], flow["tools"]) == ("workflow", ["t", "n", "t"])


def test_directories(spark, tmp_path):
    one, two = tmp_path / "one", tmp_path / "two"
    write(one, **{"agents__a.md": MARKDOWN, "skills__b.md": MARKDOWN, "agents__README.md": MARKDOWN, "agents__c.toml": 'name = "c"\ndescription = "d"\ndeveloper_instructions = "x"\n', "agents__bad.toml": "developer_instructions = ["})
    write(two, **{"d.md": MARKDOWN, "none.md": "no purpose", "plain.toml": 'name = "no"\n'})
    got = S.read_directories(spark, [str(one), str(two)])
    assert sorted((r["source"], r["framework"], r["source_path"].rsplit("/", 1)[1]) for r in got.collect()) == [("one", "claude-code", "a.md"), ("one", "codex", "c.toml"), ("two", "claude-code", "d.md")]
    assert sorted(r["row_idx"] for r in S.indexed(got).collect()) == [0, 1, 2]
    assert S.read_records(spark, str(two), "markdown").count() == 2
    assert S.read_records(spark, str(tmp_path / "missing"), "gpt").count() == 0


def test_jsonl(spark, tmp_path):
    path = str(tmp_path / "out")
    df = spark.createDataFrame([(1, "a"), (2, None)], "z long, b string")
    S.write_jsonl(df, path)
    S.append_log(df, path)
    assert sorted(r["value"] for r in spark.read.text(path).collect()) == ['{"b":"a","z":1}', '{"b":"a","z":1}', '{"b":null,"z":2}', '{"b":null,"z":2}']
    assert S.read_jsonl(spark, str(tmp_path / "none"), RECORD).count() == 0
    write(tmp_path, **{"lines.json": '{"b": "x"}\n\n{"b": "y"}\n'})
    assert S.read_jsonl(spark, str(tmp_path / "lines.json"), "b string").count() == 2


def test_yaml_tables(spark, tmp_path):
    write(tmp_path, **{"probes.yaml": "version: 1\nprobes:\n  - {id: p1, group: g, planted: bug, prompt: hi}\n  - {id: p2, prompt: there}\n", "traits.yaml": "categories:\n  language:\n    python: [python, py]\n  activity:\n    review: [review]\n"})
    probes = {r["id"]: r for r in S.read_probes(spark, str(tmp_path / "probes.yaml")).collect()}
    assert probes["p1"]["grp"] == "g" and len(probes["p1"]["hash"]) == 16 and probes["p2"]["planted"] is None
    tax = S.read_taxonomy(spark, str(tmp_path / "traits.yaml")).orderBy("place").collect()
    assert [(r["category"], r["trait"], r["phrase"]) for r in tax] == [("language", "python", "python"), ("language", "python", "py"), ("activity", "review", "review")]


def test_stream_store(spark, tmp_path):
    schema = "key string, text string, seq long"
    inbox, kept, check = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "check")
    write(inbox, **{"1.json": '{"key": "a", "text": "first", "seq": 1}\n{"key": "a", "text": "again", "seq": 2}\n{"key": "b", "text": "x", "seq": 3}\n'})
    store.keep_store(store.incoming(spark, str(inbox), schema), kept, check, schema, order="seq").awaitTermination()
    write(inbox, **{"2.json": '{"key": "b", "text": "late", "seq": 4}\n{"key": "c", "text": "y", "seq": 5}\n'})
    store.keep_store(store.incoming(spark, str(inbox), schema), kept, check, schema, order="seq").awaitTermination()
    assert sorted((r["key"], r["text"]) for r in store.stored(spark, kept, schema).collect()) == [("a", "first"), ("b", "x"), ("c", "y")]
    query = store.first_seen(store.incoming(spark, str(inbox), schema)).writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.sql("select count(*) n from seen").first()["n"] == 3


def test_flagship(spark, tmp_path):
    truth = S.synthetic(spark, 4, 3)
    assert truth.count() == 12 and truth.filter("array_contains(tools, 'write')").count() == 8
    base = truth.select(
        "row_idx", F.concat(F.lit("s"), F.col("row_idx") % 2).alias("source"), F.concat(F.lit("/x/"), "role", F.lit(".md")).alias("source_path"), F.col("agent_id").alias("name"), F.concat_ws(" ", "purpose", F.lit("job")).alias("purpose"),
        F.concat_ws(" ", F.lit("do the"), "role", "agent_id", F.lit("task with care and report what was found there")).alias("prompt"), "tools", F.array().cast("array<string>").alias("input_modes"), F.array().cast("array<string>").alias("output_modes"),
    )
    ids = estate.R.assign_ids(estate.R.dedupe_copies(base))
    vectors = {c: estate.hashed_vectors(ids, "agent_id", c) for c in ("purpose", "prompt")}
    made = estate.analyse(base, vectors, {"capability": 0.0})
    assert made.functional.count() == 66 and made.functional.filter("d < 0 or d > 1").count() == 0
    cover = {r["block"]: r["coverage"] for r in made.coverage.collect()}
    assert cover["purpose"] == 1.0 and cover["interface"] == 0.0
    top = estate.nearest(made, 5).collect()
    assert len(top) == 5 and top[0]["functional"] >= top[-1]["functional"]
    report.write_tree_outputs(spark, str(tmp_path / "out"), made.tree, estate.nearest(made, 5), made.functional, made.clusters)
    assert (tmp_path / "out/tree.nwk").read_text().startswith("(") and "<svg" in (tmp_path / "out/report.html").read_text()
    assert len(json.loads((tmp_path / "out/pairs.json").read_text())) == 5
    tree = report.collected(made.tree)
    assert report.radial_svg(tree).startswith("<svg") and len(report.colours(["a", "b"])) == 2


def test_reports():
    rows = [{"agent_id": "a<b", "pass_rate": 0.5, "wilson_low": 0.1, "wilson_high": 0.9}]
    assert "a&lt;b" in report.ranking_svg(rows) and "a&lt;b" in report.html_table(rows) and report.html_table([]) == "<p>none</p>"
    assert "| agent_id |" in report.markdown_report("t", {"n": 1}, {"rows": rows})


def test_command_line(spark, tmp_path, capsys):
    assert cli.main([]) == 0 and "usage" in capsys.readouterr().out
    assert cli.main(["experiment", "--rates", "0,0.5", "--seeds", "2"]) == 0
    assert json.loads(capsys.readouterr().out)["mean_a"] == pytest.approx(0.75)
    assert cli.main(["synth", "--roles", "2", "--agents", "6", "--out", str(tmp_path / "s")]) == 0
    assert cli.main(["validate", "--corpus", str(tmp_path / "s"), "--truth", str(tmp_path / "s")]) == 0
    assert '"accuracy": 1.0' in capsys.readouterr().out
    rows = spark.createDataFrame([("k", "a", "t", "c", 0, "m", True, 0.1, 1, "x")], RESULT)
    S.write_jsonl(rows, str(tmp_path / "r"))
    assert cli.main(["rank", "--results", str(tmp_path / "r")]) == 0
    write(tmp_path / "src" / "repo", **{f"a{k}.md": MARKDOWN.replace("code-reviewer", f"n{k}").replace("review code", f"review code {k} " + "x y z " * k) for k in range(5)})
    assert cli.main(["ingest", "--dir", str(tmp_path / "src/repo"), "--out", str(tmp_path / "c")]) == 0
    assert cli.main(["tree", "--dir", str(tmp_path / "src/repo"), "--out", str(tmp_path / "t")]) == 0
    assert (tmp_path / "t/tree.nwk").exists()


def test_registry(spark, tiny):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 90
    assert entry.entry(spark).count() > 0
    assert E.copies_per_source(spark.createDataFrame([("a",), ("a",)], "source string"), spark.createDataFrame([("a",)], "source string")).first()["copies"] == 1
