"""Plan inspection for tests and reviews (text of ``explain``)."""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def physical_plan(df: DataFrame, mode: str = "formatted") -> str:
    """The text ``df.explain(mode)`` prints."""
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode)
    return buf.getvalue()


_WINDOW = re.compile(r"^\(\d+\) Window\n(?:.*\n)*?Arguments: (.*)$", re.MULTILINE)


def _top_level_groups(text: str) -> list[str]:
    groups, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        if ch == "[":
            if depth == 0:
                start = i
            depth += 1
        elif ch == "]":
            depth -= 1
            if depth == 0:
                groups.append(text[start:i + 1])
    return groups


def has_unpartitioned_window(plan: str) -> bool:
    """True when a Window operator has no partition spec (all rows go to one
    task). In the formatted plan a Window's arguments read
    ``[window exprs], [partition spec], [order spec]``; without a partition
    spec only two groups remain."""
    return any(len(_top_level_groups(m.group(1))) < 3 for m in _WINDOW.finditer(plan))
