"""Commands: preprocess, training-tasks, evaluation-tasks, predict, evaluate, composites, per-code-tasks, per-code-auroc."""

from __future__ import annotations

import argparse
import csv
import json
import sys

from .session import get_session
from .sources.logs import parse_codes


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="hindcast", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *paths: [p := sub.add_parser(name), *(p.add_argument(f"--{x}", required=True) for x in paths)][0]
    p = add("preprocess", "events", "splits", "output")
    p.add_argument("--min-subjects-per-code", type=int, default=1000)
    p.add_argument("--min-events-per-subject", type=int, default=10)
    p.add_argument("--subjects-per-shard", type=int, default=10_000)
    p.add_argument("--overwrite", action="store_true")
    p = add("training-tasks", "data", "output", "codes")
    for name, kind, value in (("split", str, "train"), ("queries", int, 1000), ("contexts", int, 1), ("min-times", int, 50), ("min-duration", float, 1.0), ("max-duration", float, 365.0), ("law", str, "log-uniform"), ("seed", int, 1)):
        p.add_argument(f"--{name}", type=kind, default=value)
    p.add_argument("--by-row", action="store_true", help="draw on the cluster")
    p.add_argument("--overwrite", action="store_true")
    p = add("evaluation-tasks", "data", "output", "codes")
    p.add_argument("--durations", type=float, nargs="+", required=True)
    for name, kind, value in (("split", str, "held_out"), ("times-per-subject", int, 1), ("min-context", int, 50), ("seed", int, 1), ("fraction", float, None)):
        p.add_argument(f"--{name}", type=kind, default=value)
    p.add_argument("--overwrite", action="store_true")
    p = add("predict", "tasks", "events", "vocabulary", "output")
    p.add_argument("--scorer", default="hindcast.plans.predict:logistic_scorer", help="module:function")
    p.add_argument("--max-length", type=int, default=512)
    p.add_argument("--embedding", type=int)
    p.add_argument("--overwrite", action="store_true")
    add("evaluate", "predictions", "output")
    p = add("composites", "predictions", "labels", "output")
    p.add_argument("--kinds", nargs="+", default=["max", "or", "sum"])
    p = add("per-code-tasks", "wide", "labels", "codes", "output")
    p.add_argument("--duration", type=float, required=True, help="days")
    p.add_argument("--overwrite", action="store_true")
    add("per-code-auroc", "predictions", "labels", "output")
    return top


def code_list(text: str) -> list[str] | str:
    """Codes of an argument: a path stays one, a list in brackets may quote its codes, other commas divide codes."""
    if text.startswith("["):
        return parse_codes(text)
    return next(csv.reader([text])) if "," in text else text


def main(args: list[str] | None = None) -> int:
    a = parser().parse_args(args)
    spark = get_session()
    codes = code_list(a.codes) if getattr(a, "codes", None) else None
    if a.command == "preprocess":
        from .plans import preprocess as plan

        cfg = plan.PreprocessConfig(a.min_subjects_per_code, a.min_events_per_subject, a.subjects_per_shard)
        out = plan.run(spark, spark.read.parquet(a.events), spark.read.parquet(a.splits), a.output, cfg, a.overwrite)
    elif a.command == "training-tasks":
        from .plans import training as plan

        out = plan.run(spark, plan.TrainingConfig(a.data, a.output, codes, a.split, a.queries, a.contexts, a.min_times, a.min_duration, a.max_duration, a.law, a.seed, a.overwrite, by_row=a.by_row))
    elif a.command == "evaluation-tasks":
        from .plans import evaluation as plan

        out = plan.run_tasks(spark, a.data, a.output, a.split, codes, a.durations, a.times_per_subject, a.min_context, a.seed, a.fraction, a.overwrite)
    elif a.command == "predict":
        import importlib

        from .plans import predict as plan
        from .sources.logs import read_vocabulary

        module, _, name = a.scorer.partition(":")
        scorer = getattr(importlib.import_module(module), name)
        out = plan.run(spark, a.tasks, spark.read.parquet(a.events), read_vocabulary(spark, a.vocabulary), a.output, scorer, a.max_length, a.embedding, a.overwrite)
    elif a.command == "evaluate":
        from .plans import evaluation as plan

        out = [r.asDict() for r in plan.evaluate(spark, a.predictions, a.output).collect()]
    elif a.command == "per-code-tasks":
        from .plans import external as plan

        out = plan.run_per_code(spark, a.wide, a.labels, codes, a.output, a.duration, a.overwrite)
    elif a.command == "per-code-auroc":
        from .plans import external as plan

        out = [r.asDict() for r in plan.run_per_code_auroc(spark, a.predictions, a.labels, a.output).collect()]
    else:
        from .plans import external as plan

        out = [r.asDict() for r in plan.composites(spark, a.predictions, a.labels, a.output, a.kinds).collect()]
    print(json.dumps(out, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
