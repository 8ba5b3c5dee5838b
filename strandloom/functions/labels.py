"""Texts for people and from people (FN-09, FN-12, FN-14)."""

from __future__ import annotations


def duration(seconds: float) -> str:
    """``1h 02m 03s``; parts that are 0 at the front are left out."""
    whole = int(round(seconds))
    hours, minutes, rest = whole // 3600, whole % 3600 // 60, whole % 60
    if hours:
        return f"{hours}h {minutes:02d}m {rest:02d}s"
    return f"{minutes}m {rest:02d}s" if minutes else f"{rest}s"


def size_label(rows: int) -> str:
    """``2.5M``, ``250k``, ``999``."""
    for unit, sign in ((1_000_000, "M"), (1_000, "k")):
        if rows >= unit:
            return f"{rows / unit:.6g}{sign}"
    return str(rows)


def split_list(text: str) -> list[str]:
    """A comma-separated list, trimmed, without blanks and repeats, in order."""
    return list(dict.fromkeys(t for t in (p.strip() for p in text.split(",")) if t))


def split_numbers(text: str) -> list[int]:
    return [int(t) for t in split_list(text)]


def palette(n: int) -> list[str]:
    """``n`` well-spread colours: hues a golden ratio apart."""
    import colorsys

    return ["#%02x%02x%02x" % tuple(round(255 * c) for c in colorsys.hsv_to_rgb(i * 0.618033988749895 % 1, 0.65, 0.9)) for i in range(n)]
