"""Dotted subjects and metric paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def subject_regex(pattern: str) -> str:
    """Regex for a subject pattern: ``*`` is one token, a final ``>`` one or more."""
    tokens = pattern.split(".")
    parts = []
    for i, token in enumerate(tokens):
        if token == ">":
            if i != len(tokens) - 1:
                raise ValueError(f"'>' must be the last token: {pattern!r}")
            parts.append(r"[^.]+(?:[.][^.]+)*")
        elif token == "*":
            parts.append("[^.]+")
        else:
            parts.append(re.escape(token))
    return "^" + "[.]".join(parts) + "$"


def subject_matches(subject: Column, pattern: str) -> Column:
    """Whole-subject match.

    The literal head of the pattern is tested with ``startswith`` as well, because a
    Parquet scan can skip row groups on a prefix but not on a regex.
    """
    head = re.split(r"[*>]", pattern, maxsplit=1)[0]
    if head == pattern:
        return subject == pattern
    return subject.startswith(head) & subject.rlike(subject_regex(pattern))


def subject_tokens(subject: Column) -> list[Column]:
    """line, transformer and usage_point: the last three tokens, null where missing."""
    tokens = F.split(subject, "[.]")

    def token(position: int) -> Column:
        return F.try_element_at(tokens, F.lit(position)).try_cast("int")

    return [
        token(-3).alias("line"),
        token(-2).alias("transformer"),
        token(-1).alias("usage_point"),
    ]


def data_subject(prefix: str, line: Column, transformer: Column, usage_point: Column) -> Column:
    """Subject of a voltage reading below ``prefix``."""
    return F.concat_ws(".", F.lit(prefix), line, transformer, usage_point)


def append_token(subject: Column, suffix: str) -> Column:
    """Output subject of a job, e.g. ``extract`` and ``voltage.max``."""
    return F.concat(subject, F.lit("." + suffix))


def reroute(subject: Column, old: str, new: str) -> Column:
    """Redirect a subject by replacing every ``old`` in it."""
    return F.replace(subject, F.lit(old), F.lit(new))


def alert_subject(subject: Column) -> Column:
    return reroute(subject, "max", "alert")


def report_subject(subject: Column) -> Column:
    return reroute(subject, "extract", "report")


def metric_path(*parts: Column) -> Column:
    """``prefix.host.tags.measurement.field``; null parts are left out."""
    return F.concat_ws(".", *parts)


def path_node(path: Column, index: int) -> Column:
    """Node ``index`` (from 0) of a dotted path, null beyond its end."""
    return F.get(F.split(path, "[.]"), F.lit(index))


def path_matches(path: Column, glob: str) -> Column:
    """Glob over a metric path; ``*`` and ``?`` never cross a dot."""
    regex = re.escape(glob).replace(r"\*", "[^.]*").replace(r"\?", "[^.]")
    head = re.split(r"[*?]", glob, maxsplit=1)[0]
    return path.startswith(head) & path.rlike(f"^{regex}$")
