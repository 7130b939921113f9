"""Command line: python -m tessera WAREHOUSE COMMAND [...].

    index FOLDER            index a folder, print what changed
    tools                   list the queries
    run TOOL [key=value]    run a query and print its rows as JSON lines
    scan REPO               security findings; exit code 2 if any is high or critical

Exit codes: 0 done, 1 a wrong call or an error, 2 findings.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession

from tessera.engine import Engine

FAILING = ("critical", "high")


def _value(text: str):
    """JSON where it is JSON, else the text itself."""
    try:
        return json.loads(text)
    except ValueError:
        return text


def _print(result) -> None:
    for part in result if isinstance(result, tuple) else (result,):
        if isinstance(part, DataFrame):
            for row in part.toJSON().toLocalIterator():
                print(row)
        else:
            print(part if isinstance(part, str) else json.dumps(part))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("warehouse")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("tools")
    sub.add_parser("index").add_argument("folder")
    run = sub.add_parser("run")
    run.add_argument("tool")
    run.add_argument("args", nargs="*", metavar="key=value")
    scan = sub.add_parser("scan")
    scan.add_argument("repo")
    scan.add_argument("--severity", choices=["critical", "high", "medium", "low"])
    try:
        asked = parser.parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    engine = Engine(spark or SparkSession.builder.appName("tessera").getOrCreate(), asked.warehouse)
    try:
        if asked.command == "tools":
            _print(engine.catalog())
        elif asked.command == "index":
            _print(engine.index_folder(asked.folder))
        elif asked.command == "run":
            pairs = [a.partition("=") for a in asked.args]
            if any(not sep for _, sep, _ in pairs):
                raise ValueError("arguments are key=value")
            _print(engine.run(asked.tool, **{k: _value(v) for k, _, v in pairs}))
        else:
            found = engine.scan_security(asked.repo, severity=asked.severity).collect()
            for row in found:
                print(json.dumps(row.asDict(True), default=str))
            return 2 if any(row["severity"] in FAILING for row in found) else 0
    except Exception as e:  # noqa: BLE001 - the command's answer to any failure is a message and a code
        print(f"error: {engine.safe_message(e)}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
