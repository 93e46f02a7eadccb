"""A thin command line over the library."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from simlattice.operators import evaluate, tournament
from simlattice.operators import records as R
from simlattice.plans import estate
from simlattice.schema import RECORD, RESULT
from simlattice.sources import records as S
from simlattice.sources import report


def _weights(text: str) -> dict[str, float]:
    return {k: float(v) for k, v in (x.split("=") for x in text.split(",") if x)}


def ingest(spark: SparkSession, args: argparse.Namespace) -> dict:
    rows = S.read_directories(spark, args.dir) if args.format == "directory" else S.read_records(spark, args.dir, args.format)
    S.write_jsonl(rows, args.out)
    return {"records": S.read_jsonl(spark, args.out, RECORD).count()}


def tree(spark: SparkSession, args: argparse.Namespace) -> dict:
    rows = S.indexed(S.read_jsonl(spark, args.corpus, RECORD) if args.corpus else S.read_directories(spark, args.dir))
    ids = R.assign_ids(R.dedupe_copies(rows))
    vectors = {c: estate.hashed_vectors(ids, "agent_id", c) for c in ("purpose", "prompt")}
    made = estate.analyse(rows, vectors, _weights(args.weights))
    report.write_tree_outputs(spark, args.out, made.tree, estate.nearest(made, args.top), made.functional, made.clusters)
    return {"records": made.records.count(), "coverage": {r["block"]: r["coverage"] for r in made.coverage.collect()}}


def synth(spark: SparkSession, args: argparse.Namespace) -> dict:
    rows = S.synthetic(spark, args.roles, args.agents // max(args.roles, 1))
    S.write_jsonl(rows, args.out)
    return {"agents": rows.count()}


def validate(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The share of records whose purpose is the role at their place."""
    rows = spark.read.json(args.corpus).select("row_idx", "purpose")
    truth = spark.read.json(args.truth).select("row_idx", "role")
    return evaluate.accuracy(rows.join(truth, "row_idx", "left").withColumn("role", F.coalesce("role", F.lit(""))), "purpose", "role").first().asDict()


def experiment(spark: SparkSession, args: argparse.Namespace) -> dict:
    return evaluate.h1_summary(evaluate.experiment(spark.range(1), [float(x) for x in args.rates.split(",")], args.seeds)).first().asDict()


def rank(spark: SparkSession, args: argparse.Namespace) -> dict:
    rows = S.read_jsonl(spark, args.results, RESULT)
    rows = tournament.of_model(rows, args.model, args.legacy) if args.model else rows
    return {"ranking": [r.asDict() for r in tournament.ranking(rows).collect()]}


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="simlattice")
    sub = parser.add_subparsers(dest="command")
    p = sub.add_parser("ingest", help="read definitions into one JSON corpus")
    p.add_argument("--dir", action="append", required=True)
    p.add_argument("--format", default="directory", choices=["directory", *S.PARSERS])
    p.add_argument("--out", required=True)
    p = sub.add_parser("tree", help="distances, nearest pairs, tree and clusters")
    p.add_argument("--dir", action="append", default=[])
    p.add_argument("--corpus")
    p.add_argument("--out", required=True)
    p.add_argument("--top", type=int, default=50)
    p.add_argument("--weights", default="purpose=1,prompt=1,capability=0,interface=1")
    p = sub.add_parser("synth", help="a synthetic corpus")
    p.add_argument("--roles", type=int, default=20)
    p.add_argument("--agents", type=int, default=200)
    p.add_argument("--out", required=True)
    p = sub.add_parser("validate", help="accuracy against known roles")
    p.add_argument("--corpus", required=True)
    p.add_argument("--truth", required=True)
    p = sub.add_parser("experiment", help="the placeholder drift experiment")
    p.add_argument("--rates", default="0.0,0.1,0.3")
    p.add_argument("--seeds", type=int, default=20)
    p = sub.add_parser("rank", help="rank entrants of a tournament")
    p.add_argument("--results", required=True)
    p.add_argument("--model")
    p.add_argument("--legacy", default="")
    return parser


COMMANDS = {f.__name__: f for f in (ingest, tree, synth, validate, experiment, rank)}


def main(argv: list[str] | None = None) -> int:
    parser = build_parser()
    args = parser.parse_args(argv)
    if args.command is None:
        parser.print_help()
        return 0
    spark = SparkSession.builder.appName("simlattice").getOrCreate()
    print(json.dumps(COMMANDS[args.command](spark, args), indent=2, default=str))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
