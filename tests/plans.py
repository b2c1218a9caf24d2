"""Reading physical plans."""

from __future__ import annotations

import contextlib
import io


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


def bad_operators(df) -> list[str]:
    """What a plan for large data must not have: all pairs, per-row Python, a window over one partition.

    The window that carries values from range to range (marked ``_seen``) has one row per range.
    """
    lines = plan_of(df).splitlines()
    out = [x for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "InPandas", "MapInArrow")
           if any(x in line for line in lines)]
    for i, line in enumerate(lines):
        near = lines[i + 1:i + 4]
        if "Window [" in line and " AS _seen#" not in line and any("Exchange SinglePartition" in x for x in near):
            out.append(line.strip())
    return out
