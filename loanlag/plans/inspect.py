"""Reading physical plans: the checks the test-suite runs on every query."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame

# Operators that would mean a per-row Python hop or an all-pairs product.
PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas",
                "MapInPandas", "PythonUDF")
PAIR_NODES = ("CartesianProduct", "BroadcastNestedLoopJoin")


def plan_text(df: DataFrame, mode: str = "formatted") -> str:
    """``df.explain(mode)`` as a string."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def plan_problems(df: DataFrame) -> list[str]:
    """Names of unwanted physical operators found in ``df``'s plan."""
    text = plan_text(df)
    return [node for node in PYTHON_NODES + PAIR_NODES if node in text]


def exchange_count(df: DataFrame) -> int:
    """Number of shuffle exchanges in the physical plan (before AQE)."""
    return len(re.findall(r"^\(\d+\) Exchange", plan_text(df), flags=re.M))


def scanned_columns(df: DataFrame) -> list[list[str]]:
    """The ``ReadSchema`` column lists of every file scan in the plan."""
    out = []
    for schema in re.findall(r"ReadSchema: struct<([^\n]*)>", plan_text(df)):
        out.append([field.split(":")[0] for field in re.split(r",(?![^<]*>)", schema) if field])
    return out
