"""python -m heddle.cli: validate-config, run, report, backfill and deactivate-metric over JSON configurations."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

from heddle.api import Quality, check_config
from heddle.operators import lifecycle


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="heddle")
    sub = top.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [p := sub.add_parser(name), [p.add_argument(a, **o) for a, o in args]][0]
    config, store = ("config", {}), ("--history", {"required": True})
    add("validate-config", config)
    add("run", config, store, ("--now", {}))
    add("report", store, ("--days", {"type": int, "default": 30}), ("--now", {}))
    add("backfill", config, store, ("--start", {"required": True}), ("--end", {}), ("--now", {}))
    add("deactivate-metric", store, ("--dataset", {"required": True}), ("--metric", {"required": True}), ("--note", {}), ("--now", {}))
    return top


def main(args: Sequence[str] | None = None, spark=None) -> int:
    """0, or 1 for a configuration that is wrong, 2 for validations that failed."""
    a = _parser().parse_args(args)
    config = {}
    if getattr(a, "config", None):
        with open(a.config) as f:
            config = json.load(f)
    if a.command == "validate-config":
        wrong = check_config(config)
        print("\n".join(wrong) or "ok")
        return int(bool(wrong))
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    q = Quality(spark, a.history, a.now)
    if a.command == "run":
        try:
            print(json.dumps(q.run(config)))
        except lifecycle.ValidationFailed as e:
            print(e)
            return 2
    elif a.command == "report":
        q.health_report(a.days).orderBy("section", "key").show(1000, truncate=False)
    elif a.command == "backfill":
        diff = q.backfill(config, lifecycle.anchors(a.start, a.end, config.get("step", "P1D")))
        print(json.dumps({r[0]: r[1] for r in diff.groupBy("state").count().collect()}))
    else:
        print(q.deactivate(a.note, dataset_name=a.dataset, metric_name=a.metric))
    return 0


if __name__ == "__main__":
    sys.exit(main())
