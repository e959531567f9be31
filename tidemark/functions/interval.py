"""The interval language: durations (``15m``), moments (``now-1h``) and periods (``now-7d:now``).

All times are whole milliseconds. Nothing here reads the clock unless no ``now``
is given.
"""

from __future__ import annotations

import math
import re
import time

from ..errors import TidemarkError, require

# Milliseconds in each unit.
UNITS = {
    "ms": 1,
    "s": 1_000,
    "m": 60_000,
    "h": 3_600_000,
    "d": 86_400_000,
    "w": 604_800_000,
    "mon": 2_592_000_000,
    "y": 31_536_000_000,
}

_DURATION = re.compile(r"(\d+)([A-Za-z]*)")
_STEP = re.compile(r"([+-]?)([^+-]+)")


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def _finite(x) -> bool:
    return isinstance(x, (int, float)) and not isinstance(x, bool) and math.isfinite(x)


def parse_interval(text: str) -> int:
    """A duration in milliseconds; a bare number is milliseconds. No fractions, no sign."""
    found = _DURATION.fullmatch(re.sub(r"\s", "", text)) if isinstance(text, str) else None
    require(found is not None, "INT_PARSE", "not a duration such as 10s or 1h", text=text)
    unit = found[2] or "ms"
    require(unit in UNITS, "INT_UNIT_UNKNOWN", f"units are {' '.join(UNITS)}", unit=unit)
    return int(found[1]) * UNITS[unit]


def moment(text: str, now: int | None = None) -> int:
    """``now``, milliseconds, and durations added or taken away. A sign holds until the next one."""
    body = re.sub(r"\s", "", text)
    steps = _STEP.findall(body)
    require(bool(steps) and "".join(a + b for a, b in steps) == body, "INT_PARSE", "not a moment such as now-1h", text=text)
    at, sign = 0, 1
    for mark, step in steps:
        sign = {"+": 1, "-": -1}.get(mark, sign)
        at += sign * ((now_ms() if now is None else now) if step == "now" else parse_interval(step))
    return at


def resolve(value: int | float | str, now: int | None = None) -> int | float:
    """A bound given as a number or as a moment."""
    if isinstance(value, str):
        return moment(value, now)
    require(_finite(value), "INT_RESOLVE", "a bound is a finite number or a moment", value=value)
    return value


def period(start, end=None, now: int | None = None) -> tuple[int | float, int | float]:
    """Two bounds, or one text ``start:end``, resolved against the same ``now``."""
    now = now_ms() if now is None else now
    if end is None:
        require(isinstance(start, str), "INT_PERIOD_ARGS", "two bounds or a text start:end")
        parts = start.split(":")
        require(len(parts) == 2 and all(p.strip() for p in parts), "INT_PERIOD_FORMAT", "start:end", text=start)
        start, end = parts
    a, b = resolve(start, now), resolve(end, now)
    require(a <= b, "INT_RANGE_ORDER", "start must not be after end", start=a, end=b)
    return a, b


def _whole(x, code: str, least: int | None = None) -> int:
    ok = _finite(x) and float(x).is_integer() and (least is None or x >= least)
    require(ok, code, "a whole number" + (f" of {least} or more" if least is not None else ""), value=x)
    return int(x)


def round_time(t: int, step: int) -> int:
    """The multiple of ``step`` at or before ``t`` (for negative ``t``, towards zero)."""
    t, step = _whole(t, "INT_TIME_NOT_INT"), _whole(step, "INT_PRECISION", 1)
    return t - int(math.fmod(t, step))


def grid(start: int, end: int, step: int) -> list[int]:
    """All multiples of ``step`` from the one of ``start`` to the one of ``end``."""
    first, last = round_time(start, step), round_time(end, step)
    require(first <= last, "INT_RANGE_ORDER", "start must not be after end")
    return list(range(first, last + 1, int(step)))


def step_for_count(start: int, end: int, count: int) -> int:
    """The step that divides a period into about ``count`` parts, 1 at least."""
    return max(1, abs(int(start) - int(end)) // _whole(count, "INT_PRECISION", 1))


def duration(value: int | str, code: str) -> int:
    """A positive duration given as text or as whole milliseconds."""
    try:
        ms = parse_interval(value) if isinstance(value, str) else value
    except TidemarkError as e:
        raise TidemarkError(code, str(e)) from e
    require(_finite(ms) and float(ms).is_integer() and ms > 0, code, "a positive number of milliseconds or a text such as 15m", value=value)
    return int(ms)
