"""``python -m meshloom`` with ``build CONFIG -o FOLDER``, ``scenario CONFIG -o FOLDER``, ``info CONFIG``, ``batch CONFIGS FOLDER`` or ``validate DOCUMENTS --schema FILE``.

Exit codes: 2 for the configuration, 3 for a scenario with issues or documents that break their schema, 1 for anything else that fails.
"""

from __future__ import annotations

import argparse
import sys

import yaml
from pyspark.sql import SparkSession

from meshloom import assemble, config, run
from meshloom.operators import schema_check
from meshloom.sources import documents


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run a command; an existing session may be given."""
    parser = argparse.ArgumentParser(prog="meshloom")
    commands = parser.add_subparsers(dest="command", required=True)
    command = commands.add_parser("build", help="write roads, metros and corridors; stages of which nothing has changed are left as they are")
    command.add_argument("config")
    command.add_argument("-o", "--output", required=True)
    command.add_argument("--force", action="store_true", help="make every stage again")
    command = commands.add_parser("scenario", help="build, and write the scenario's document with its audits")
    command.add_argument("config")
    command.add_argument("-o", "--output", required=True)
    command.add_argument("--force", action="store_true", help="make every stage again")
    commands.add_parser("info", help="print the whole configuration").add_argument("config")
    command = commands.add_parser("batch", help="build every configuration of a folder, each into a folder of its name")
    command.add_argument("configs")
    command.add_argument("output")
    command.add_argument("--include", action="append", default=[], help="glob of file names; may be repeated")
    command.add_argument("--exclude", action="append", default=[], help="glob of file names; may be repeated")
    command.add_argument("--force", action="store_true", help="make every stage again")
    command = commands.add_parser("validate", help="check documents, YAML or JSON, against a JSON schema")
    command.add_argument("documents", help="a file, folder or glob")
    command.add_argument("--schema", required=True)
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("meshloom").getOrCreate()
    if given.command == "batch":
        return _batch(spark, given)
    if given.command == "validate":
        return _validate(spark, given)
    try:
        found = config.load(spark, given.config)
    except Exception as e:  # a missing file is the file system's own error
        print(f"configuration: {e}", file=sys.stderr)
        return 2
    if given.command == "info":
        print(yaml.safe_dump(found, sort_keys=False), end="")
        return 0
    if given.command == "scenario":
        return _scenario(spark, found, given)
    try:
        tables, fresh = run.build(spark, found, given.output, given.force)
        for name, table in tables.items():
            print(f"{name}: {table.count()} rows{'' if name in fresh else ', as they were'}")
    except Exception as e:
        print(f"{given.command}: {e}", file=sys.stderr)
        return 1
    return 0


def _scenario(spark: SparkSession, found: dict, given: argparse.Namespace) -> int:
    try:
        made, _, path = assemble.build(spark, found, given.output, given.force)
        bad = 0
        for r in assemble.issues(spark, found, made, path).orderBy("audit", "key", "message").toLocalIterator():
            bad += 1
            print(f"{r.audit} {r.key}: {r.message}")
    except Exception as e:
        print(f"scenario: {e}", file=sys.stderr)
        return 1
    print(f"{path}: {bad} issues")
    return 3 if bad else 0


def _batch(spark: SparkSession, given: argparse.Namespace) -> int:
    failed = 0
    try:
        for done in run.batch(spark, given.configs, given.output, given.include, given.exclude, given.force):
            failed += done.state != "ok"
            print(f"{done.name}: {done.state}" + (f", {done.error}" if done.error else f", made {', '.join(done.fresh) or 'nothing'}"))
    except Exception as e:  # a missing folder is the file system's own error
        print(f"batch: {e}", file=sys.stderr)
        return 1
    return 1 if failed else 0


def _validate(spark: SparkSession, given: argparse.Namespace) -> int:
    try:
        rules = documents.one(spark, given.schema)
        found = schema_check.check(documents.read(spark, given.documents), rules, "path", "text").orderBy("key", "path", "rule")
        issues = 0
        for r in found.toLocalIterator():
            issues += 1
            print(f"{r.key} {r.path} {r.rule}: {r.message}")
    except Exception as e:
        print(f"validate: {e}", file=sys.stderr)
        return 1
    print(f"{issues} issues")
    return 3 if issues else 0


if __name__ == "__main__":
    sys.exit(main())
