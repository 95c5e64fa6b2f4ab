"""Command line: spark-submit or python -m veerline.cli COMMAND ... writes a corpus' tables or prints a report.

    convert KIND RAW OUT [NOTES]       raw corpus to records, content and labels (Parquet) and a manifest; --only pipeline=a,b reads some paths alone
    run EXPERIMENT OUT [--set a=1 ...] an experiment over converted tables, as Markdown; --to FOLDER writes its tables
    list                               the experiments, and the tables that each reads
"""

from __future__ import annotations

import argparse
import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .plans import experiments as E
from .plans.report import markdown
from .sources import corpora, datasource, files

KINDS = {
    "injection": lambda spark, raw, notes, docs: corpora.injection_runs(spark, raw, docs),
    "coding": lambda spark, raw, notes, docs: corpora.coding_runs(spark, raw, docs=docs),
    "terminal": lambda spark, raw, notes, docs: corpora.terminal_runs(spark, raw, docs),
    "exported": lambda spark, raw, notes, docs: corpora.exported_trajectories(spark, raw, docs=docs),
    "spans": lambda spark, raw, notes, docs: corpora.span_traces(spark, raw, notes, "spans", docs),
    "blamed": lambda spark, raw, notes, docs: corpora.blamed_runs(spark, raw, "blamed", docs),
    "chat": lambda spark, raw, notes, docs: corpora.chat_sessions(spark, raw, notes),
    "hallucination": lambda spark, raw, notes, docs: corpora.hallucination_runs(spark, raw, docs),
}


@dataclass(frozen=True)
class Experiment:
    """run: a function of tables, in their order, and of settings."""

    run: Callable[..., dict[str, DataFrame] | DataFrame]
    tables: tuple[str, ...]


def _swept(records: DataFrame, content: DataFrame, labels: DataFrame, trials: int = 10, margin: float = 2.0, windows: str = "50,200,800,3200") -> DataFrame:
    words = E.token_records(records.withColumnRenamed("agent_id", "model_dir"), content, ("model_dir",))
    clean, bad = (labels.where(labels.classification == c).select("model_dir", "run_id") for c in (E.CLEAN_CLASS, E.HACKED_CLASS))
    order = lambda ids: E.X.hashed(ids.join(words.select("model_dir", "run_id").distinct(), ["model_dir", "run_id"]), trials, ("model_dir",))
    return E.window_sweep(words, order(clean), order(bad), tuple(int(w) for w in str(windows).split(",")), margin, ("model_dir",))


def _words(records: DataFrame, content: DataFrame, labels: DataFrame, **how) -> dict[str, DataFrame]:
    words = E.token_records(records.withColumnRenamed("agent_id", "model_dir"), content, ("model_dir",))
    return E.terminal(words.withColumnRenamed("model_dir", "agent_id"), labels, **how)


_TWO, _THREE = ("records", "labels"), ("records", "content", "labels")
EXPERIMENTS = {
    "injection": Experiment(E.injection, _TWO),
    "terminal": Experiment(E.terminal, _TWO),
    "exported": Experiment(E.exported, _TWO),
    "words": Experiment(_words, _THREE),
    "sweep": Experiment(_swept, _THREE),
    "submissions": Experiment(lambda records, families="", **how: E.submissions(records, [f for f in str(families).split(",") if f], **how), ("records",)),
    "span-coverage": Experiment(E.span_coverage, _TWO),
    "span-content": Experiment(E.span_content, _THREE),
    "command-rules": Experiment(E.command_rules, ("content", "labels")),
    "reasoning-patterns": Experiment(E.reasoning_patterns, ("content", "labels")),
    "transfer": Experiment(E.transfer, ("content", "labels")),
    "injection-features": Experiment(E.injection_features, ("content", "labels")),
    "visibility": Experiment(E.visibility, _TWO),
    "blame": Experiment(E.blame, ("content", "labels")),
    "hallucination": Experiment(E.hallucination, ("content", "labels")),
    "timeline-null": Experiment(E.timeline_null, ("records",)),
    "timeline-versions": Experiment(E.timeline_versions, ("records",)),
    "fingerprints": Experiment(E.fingerprints, ("records",)),
}


def convert(spark: SparkSession, kind: str, raw: str, out: str, notes: str | None = None, **only: list[str]) -> dict:
    """Tables of a corpus below out, and manifest.json with their rows, digests and what was skipped. only: as in datasource.corpus()."""
    c = KINDS[kind](spark, raw, notes, datasource.corpus(spark, kind, raw, **only) if only else None)
    tables = {n: t for n, t in (("records", c.records), ("content", c.content), ("labels", c.labels), ("skipped", c.skipped)) if t is not None}
    for name, t in tables.items():
        files.write_table(t, f"{out}/{name}")
    return files.write_manifest(f"{out}/manifest.json", **{n: spark.read.parquet(f"{out}/{n}") for n in tables})


def run(spark: SparkSession, name: str, out: str, **settings) -> dict[str, DataFrame]:
    """The tables of an experiment over a converted corpus."""
    e = EXPERIMENTS[name]
    found = e.run(*(spark.read.parquet(f"{out}/{t}") for t in e.tables), **settings)
    return found if isinstance(found, dict) else {name: found}


def _pairs(given: list[str]) -> dict[str, str]:
    return dict(x.split("=", 1) for x in given)


def _value(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return text


def main(args: list[str] | None = None) -> str:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("convert")
    c.add_argument("kind", choices=sorted(KINDS))
    c.add_argument("raw")
    c.add_argument("out")
    c.add_argument("notes", nargs="?")
    c.add_argument("--only", nargs="*", default=[], metavar="COLUMN=A,B")
    r = sub.add_parser("run")
    r.add_argument("experiment", choices=sorted(EXPERIMENTS))
    r.add_argument("out")
    r.add_argument("--set", nargs="*", default=[], metavar="NAME=VALUE")
    r.add_argument("--to")
    sub.add_parser("list")
    a = p.parse_args(args)
    if a.command == "list":
        text = "\n".join(f"{n}: {', '.join(e.tables)}; {inspect.signature(e.run)}" for n, e in sorted(EXPERIMENTS.items()))
    elif a.command == "convert":
        found = convert(SparkSession.builder.getOrCreate(), a.kind, a.raw, a.out, a.notes, **{k: v.split(",") for k, v in _pairs(a.only).items()})
        text = "\n".join(f"{n}: {x['n']} rows, {x['sha256']}" for n, x in found.items())
    else:
        tables = run(SparkSession.builder.getOrCreate(), a.experiment, a.out, **{k: _value(v) for k, v in _pairs(a.set).items()})
        for n, t in tables.items() if a.to else ():
            files.write_table(t, f"{a.to}/{n}")
        text = "\n".join(markdown(n, t) for n, t in tables.items())
    print(text)
    return text


if __name__ == "__main__":
    main()
