"""Findings of an external scanner, where one is installed on the driver."""

from __future__ import annotations

import json
import os
import shutil
import subprocess

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "status string, rule_id string, path string, line int, message string, severity string"
#: The scanner and its rule set (fixed values), seconds that it may take, and findings that a report has at most.
COMMAND = ["semgrep", "--config=p/owasp-top-ten", "--json", "--quiet"]
SECONDS, REPORTED = 120, 50
#: Variables with one of these in their names are not passed on.
PRIVATE = ("KEY", "TOKEN", "SECRET", "PASSWORD", "CREDENTIAL")


def _environment() -> dict[str, str]:
    return {k: v for k, v in os.environ.items() if not any(p in k.upper() for p in PRIVATE)}


def findings(spark: SparkSession, folder: str, roots: list[str] | None = None) -> DataFrame:
    """The first REPORTED findings in a folder on the driver, status 'found'. A scanner that is missing or fails, no folder
    or one outside all `roots` give one row with status 'unavailable', 'failed', 'no folder' or 'not allowed'; nothing
    found, no rows."""
    say = lambda status: spark.createDataFrame([(status, None, None, None, None, None)], SCHEMA)
    program, at = shutil.which(COMMAND[0]), os.path.realpath(os.path.expanduser(folder))
    if not program:
        return say("unavailable")
    inside = [os.path.realpath(os.path.expanduser(r)) for r in roots or [] if r.strip()]
    if roots and not any(os.path.commonpath([r, at]) == r for r in inside):
        return say("not allowed")
    if not os.path.isdir(at):
        return say("no folder")
    try:
        said = subprocess.run([program, *COMMAND[1:], at], capture_output=True, timeout=SECONDS, env=_environment(), check=False)
        results = json.loads(said.stdout)["results"][:REPORTED]
        rows = [("found", str(r.get("check_id", "")), str(r.get("path", "")), int(r.get("start", {}).get("line", 0)), str(r.get("extra", {}).get("message", "")), str(r.get("extra", {}).get("severity", ""))) for r in results]
    except (OSError, subprocess.TimeoutExpired, ValueError, KeyError, TypeError, AttributeError):
        return say("failed")
    return spark.createDataFrame(rows, SCHEMA)
