"""Texts and decisions on the driver: durations, tables, restart rules."""

from __future__ import annotations

import re

_UNITS = {"": 1, "s": 1, "m": 60, "h": 3600, "d": 86400}


def duration(text: str) -> float:
    """Seconds of ``90``, ``90s``, ``10m``, ``1.5h`` or ``2d``."""
    m = re.fullmatch(r"(\d+(?:\.\d+)?)([smhd]?)", text)
    if m is None or float(m[1]) <= 0:
        raise ValueError(f"not a duration: {text!r}")
    return float(m[1]) * _UNITS[m[2]]


def percent(x: float | None) -> str:
    return "–" if x is None else f"{x:.1%}"


def number(x: float | None, digits: int = 1) -> str:
    return "–" if x is None else f"{x:.{digits}f}"


def table(header: list[str], rows: list[list[str]]) -> str:
    """A Markdown table."""
    lines = [header, ["---"] * len(header), *rows]
    return "".join(f"| {' | '.join(map(str, x))} |\n" for x in lines)


def sweep(scores: list[dict]) -> str:
    """A threshold sweep (rows of evaluate.score) as a table."""
    names = ["accuracy", "precision", "uncategorized", "level1", "level2"]
    return table(["Threshold", *(n.capitalize() for n in names)], [[f"{r['threshold']:.2f}", *(percent(r[n]) for n in names)] for r in sorted(scores, key=lambda r: r["threshold"])])


def recalls(rows: list[dict]) -> str:
    return table(["k", "Exact", "L2", "L1"], [[r["k"], percent(r["exact"]), percent(r["level2"]), percent(r["level1"])] for r in sorted(rows, key=lambda r: r["k"])])


def restart(exits: list[float], now: float, *, limit: int = 5, window: float = 60.0) -> float | None:
    """Seconds to wait before a job that has ended at these times is started again: doubling from 1; None once
    it has ended too often within the window."""
    recent = [t for t in exits if now - t <= window]
    return None if len(recent) >= limit else float(2 ** max(0, len(recent) - 1))
