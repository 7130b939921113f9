"""Unified diffs as hunk rows."""

from __future__ import annotations

import re
import subprocess

from pyspark.sql import DataFrame, SparkSession

HUNK = re.compile(r"^@@ -\d+(?:,\d+)? \+(?P<start>\d+)(?:,(?P<count>\d+))? @@")
REF = re.compile(r"[A-Za-z0-9_.^~/:@{}\-]{1,200}")


def parse(diff: str) -> list[tuple[str, int, int, int]]:
    """(file, first line, last line, order) of what a diff adds or changes on its new side; deletions give nothing."""
    out, file = [], None
    for line in diff.splitlines():
        if line.startswith("+++ "):
            target = line[4:]
            file = None if target == "/dev/null" else target.removeprefix("b/")
        elif file and (m := HUNK.match(line)):
            start, count = int(m["start"]), int(m["count"] or 1)
            if count:
                out.append((file, start, start + count - 1, len(out)))
    return out


def hunks(spark: SparkSession, diff: str, repo: str) -> DataFrame:
    return spark.createDataFrame([(repo, *h) for h in parse(diff)], "repo string, file string, start int, end int, hunk_ord int")


def git_diff(folder: str, ref: str) -> str:
    """Diff text of a reference range in a work tree (driver only)."""
    if not REF.fullmatch(ref) or ref.startswith("-"):
        raise ValueError("not a git reference")
    return subprocess.run(["git", "-C", folder, "diff", "--unified=0", "--no-color", ref], capture_output=True, text=True, timeout=30, check=True).stdout


def git_head(folder: str) -> str | None:
    r = subprocess.run(["git", "-C", folder, "rev-parse", "HEAD"], capture_output=True, text=True, timeout=5)
    return r.stdout.strip() or None if r.returncode == 0 else None
