"""Include and exclude rules."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INCLUDE, EXCLUDE, INCLUDE_REGEX, EXCLUDE_REGEX = "+", "-", "i:", "e:"


def _kind(rule: str) -> str | None:
    return next((p for p in (INCLUDE, EXCLUDE, INCLUDE_REGEX, EXCLUDE_REGEX) if rule.startswith(p)), None)


def _compile(expression: str) -> None:
    """Refuse what the engine that will run it refuses: Java's where a session is active."""
    active = SparkSession.getActiveSession()
    if active is None:
        re.compile(expression)
        return
    try:
        active._jvm.java.util.regex.Pattern.compile(expression)
    except Exception as e:
        raise ValueError(f"bad regular expression {expression!r}") from e


def parse_rules(lines: list[str], folder: str = ".", _open: tuple[str, ...] = ()) -> list[str]:
    """Rules of a filter file, in order and each once.

    Blank lines and comments go, ``@file`` is replaced by that file's rules (relative to the file
    that names it; a cycle is an error), rules without a mark include, empty ones go, and regular
    expressions must compile.
    """
    out: list[str] = []
    for line in map(str.strip, lines):
        if not line or line.startswith("#"):
            continue
        if line.startswith("@"):
            path = os.path.abspath(os.path.join(folder, line[1:].strip()))
            if path in _open:
                raise ValueError(f"{path} includes itself")
            with open(path, encoding="utf-8") as f:
                found = parse_rules(f.read().splitlines(), os.path.dirname(path), (*_open, path))
        else:
            rule = line if _kind(line) else INCLUDE + line
            if rule in (INCLUDE, EXCLUDE, INCLUDE_REGEX, EXCLUDE_REGEX):
                continue
            if _kind(rule) in (INCLUDE_REGEX, EXCLUDE_REGEX):
                _compile(rule[2:])
            found = [rule]
        out += [r for r in found if r not in out]
    return out


def parse_cli_rules(rules: list[str]) -> list[str]:
    """Rules given on a command line: doubled marks count once."""
    return parse_rules([re.sub(r"^(\+\+|--)", lambda m: m[0][0], r) for r in rules])


def wildcard(path: Column, pattern: str) -> Column:
    """Whole match; ``*`` stands for any run, slashes included, ``?`` for one character."""
    special = pattern.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return path.like(special.replace("*", "%").replace("?", "_"))


def rule_column(path: Column, rules: list[str]) -> Column:
    """Whether a path is included: the first rule that matches decides, folded into one CASE.

    Without a match it is excluded if all rules include, else included.
    """
    default = not rules or any(r.startswith((EXCLUDE, EXCLUDE_REGEX)) for r in rules)
    out = F.lit(default)
    for rule in reversed(rules):
        kind = _kind(rule)
        met = wildcard(path, rule[1:]) if kind in (INCLUDE, EXCLUDE) else path.rlike(rule[2:])
        out = F.when(met, kind in (INCLUDE, INCLUDE_REGEX)).otherwise(out)
    return out


def without_marked(entries: DataFrame, marker: str) -> DataFrame:
    """Entries without the contents of directories that hold the marker file, the top one included; the directories stay."""
    marked = entries.filter(F.col("path").endswith(f"/{marker}") | (F.col("path") == marker)).select(F.expr(f"left(path, length(path) - {len(marker)})").alias("top"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/")))
    inside = entries.select("path", F.explode(F.concat(F.array(F.lit("")), above)).alias("top")).filter("top <> path").join(marked.distinct(), "top", "left_semi").select("path").distinct()
    return entries.join(inside, "path", "left_anti")


def without_attribute(entries: DataFrame, name: str = "chunkmere_exclude") -> DataFrame:
    """Entries whose extended attributes don't ask to be left out."""
    return entries.filter(~F.coalesce(F.map_contains_key("attributes", name), F.lit(False)))
