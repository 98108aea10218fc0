"""Command line: python -m palimpsest COMMAND …, over JSON dialogues and memories that `extract` wrote."""

from __future__ import annotations

import argparse
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import evaluation, extraction, merging
from palimpsest.plans import compress
from palimpsest.sources import dialogues, stores

GRAPHS = {"html": stores.html, "dot": stores.dot, "mermaid": stores.mermaid, "json": stores.graph_json, "outline": stores.outline}


def _settings(args: argparse.Namespace) -> compress.Config:
    c = compress.read_config(args.config) if args.config else compress.config(args.preset)
    return compress.config({**vars(c), "budget": args.budget}) if args.budget else c


def _lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def benchmark(turns: DataFrame, settings: dict[str, compress.Config]) -> DataFrame:
    """Means over the conversations, a row for each named configuration."""
    each = [compress.evaluate(turns, c).withColumn("config", F.lit(name)) for name, c in settings.items()]
    return evaluation.aggregate(reduce(DataFrame.unionByName, each), "config")


def report(rows: list[dict]) -> str:
    """Results as text, a block for each configuration."""
    block = lambda r: "\n".join([f"== {r['config']} ==", *(f"{k:>20}: {v:.4f}" if isinstance(v, float) else f"{k:>20}: {v}" for k, v in r.items() if k != "config")])
    return "\n\n".join(map(block, sorted(rows, key=lambda r: r["config"])))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="palimpsest", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, said: str, *paths: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name, help=said)
        for path in paths:
            c.add_argument(path)
        return c

    for name, said, paths in (("compress", "dialogues to compressed contexts", ("source", "target")), ("evaluate", "what a compression keeps", ("source",))):
        c = command(name, said, *paths)
        c.add_argument("--preset", choices=sorted(compress.PRESETS), default="default")
        c.add_argument("--config", help="a JSON or YAML file of settings")
        c.add_argument("--budget", type=int)
    command("extract", "dialogues to a memory", "source", "target")
    command("benchmark", "what each preset keeps", "source").add_argument("--presets", nargs="+", choices=sorted(compress.PRESETS), default=sorted(compress.PRESETS))
    c = command("merge", "memories into one", "target")
    c.add_argument("memories", nargs="+")
    c.add_argument("--how", choices=("union", "smart", "latest"), default="union")
    command("visualize", "a memory's graphs", "memory", "target").add_argument("--form", choices=sorted(GRAPHS), default="html")
    command("export", "a memory's entities and facts", "memory", "target").add_argument("--form", choices=("csv", "json", "jsonl", "parquet"), default="json")
    command("health", "whether Spark answers")
    return p


def run(spark: SparkSession, argv: list[str]) -> str:
    """Does what a command line asks for; returns what it prints."""
    args = parser().parse_args(argv)
    read = lambda: dialogues.read_json(spark, args.source)
    if args.command == "health":
        return f"ok: Spark {spark.version}, {spark.range(10).count()} rows counted"
    if args.command in ("evaluate", "benchmark"):
        settings = {args.preset if not args.config else args.config: _settings(args)} if args.command == "evaluate" else {p: compress.PRESETS[p] for p in args.presets}
        return report([r.asDict() for r in benchmark(read(), settings).collect()])
    if args.command == "compress":
        _lines(compress.compress(read(), _settings(args)), args.target)
    elif args.command == "extract":
        stores.write_json(extraction.extract(read()), args.target)
    elif args.command == "merge":
        stores.write_json(merging.merge([stores.read_json(spark, m) for m in args.memories], args.how), args.target)
    elif args.command == "visualize":
        _lines(GRAPHS[args.form](stores.read_json(spark, args.memory)), args.target)
    else:
        stores.export(stores.read_json(spark, args.memory), args.target, args.form)
    return f"written: {args.target}"


if __name__ == "__main__":
    print(run(SparkSession.builder.appName("palimpsest").getOrCreate(), sys.argv[1:]))
