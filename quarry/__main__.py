"""python -m quarry inspect|suggest|plan|build DUMP ...: profile a dump, suggest a configuration, show what one keeps, or write the copy."""

from __future__ import annotations

import argparse
import dataclasses
import json
import secrets
import sys
import uuid

from pyspark.sql import SparkSession

from .operators import closure
from .plans import finishing, inventory, report, subset, validate
from .session import ship
from .sources import config, store


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quarry", description=__doc__)
    parser.add_argument("command", choices=("inspect", "suggest", "plan", "build"))
    parser.add_argument("dump")
    parser.add_argument("--config", help="YAML; without it the defaults hold")
    parser.add_argument("--out", help="where build writes the copy")
    parser.add_argument("--exact", action="store_true", help="for dumps with DELIMITER blocks or odd line breaks")
    parser.add_argument("--index", help="a folder that keeps the index, and the rows it was made from, for the next run")
    parser.add_argument("--salt", help="of the stand-ins for names; without it a new one each time")
    parser.add_argument("--page", type=int, default=10, help="posts on a page of an archive")
    own = parser.parse_args(argv)
    spark = ship(SparkSession.builder.appName("quarry").getOrCreate())
    settings = config.load(open(own.config).read() if own.config else "")
    folder = own.index or f"{store.shared(spark)}/index-{uuid.uuid4().hex}"
    try:
        return _run(spark, own, settings, folder)
    finally:
        if not own.index:
            store.drop(spark, folder)  # it holds the dump's texts


def _run(spark: SparkSession, own: argparse.Namespace, settings: config.Config, folder: str) -> int:
    index = subset.build_index(spark, own.dump, own.exact, tuple(c for _, c in settings.tables.values() if c), folder)
    if own.command == "inspect":
        print(json.dumps({k: [r.asDict(True) for r in v.collect()] for k, v in inventory.inventory(index).items()}, indent=2, default=str))
        return 0
    if own.command == "suggest":
        made = {"post_types": inventory.suggestion(index)} | {"sites": {str(s): {"post_types": inventory.suggestion(index, s)} for s in index.sites if s != 1}}
        print(json.dumps({k: v for k, v in made.items() if v}, indent=2))  # JSON is YAML
        return 0
    plan = subset.make_plan(index, settings)
    found = report.report(index, plan, settings)
    print(json.dumps(found, indent=2, default=str))
    if own.command == "build":
        slimmed = subset.slim(index, plan)
        planned = {t["table"]: t["rows"] for t in found["tables"] if t["rows"]}
        written = {r.tbl: r["count"] for r in slimmed.groupBy("tbl").count().collect()}
        if planned != written:
            raise SystemExit(f"planned and written rows differ: {sorted(set(planned.items()) ^ set(written.items()))}")
        copied = closure.saved(finishing.finished(index, plan, slimmed, settings, own.salt or secrets.token_hex(16)))
        copy = subset.index_of(subset.passed(index, plan), copied)
        made = validate.reference_checks(copy, index) + validate.plan_checks(copy, index, own.page)
        made += finishing.personal_data(copy, settings) + finishing.address_check(index, plan, copy, settings) + finishing.page_check(index, plan)
        print(json.dumps({"checks": [dataclasses.asdict(c) for c in made], "status": validate.status(made)}, indent=2), file=sys.stderr)
        if not validate.export(subset.write_dump(index, plan, copied), made, own.out or own.dump + ".slim.sql"):
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
