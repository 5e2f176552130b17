"""Half-open intervals of fractions, as sorted lists of disjoint (begin, end)."""

from __future__ import annotations

Intervals = list[tuple[float, float]]


def normalise(parts: Intervals) -> Intervals:
    out: Intervals = []
    for a, b in sorted(p for p in parts if p[1] > p[0]):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def intersect(x: Intervals, y: Intervals) -> Intervals:
    return normalise([(max(a, c), min(b, d)) for a, b in x for c, d in y if max(a, c) < min(b, d)])


def subtract(x: Intervals, y: Intervals) -> Intervals:
    out = normalise(x)
    for c, d in y:
        out = [p for a, b in out for p in ((a, min(b, c)), (max(a, d), b)) if p[1] > p[0]]
    return normalise(out)


def length(x: Intervals) -> float:
    return sum(b - a for a, b in x)


def rescale(x: Intervals, begin: float, end: float) -> Intervals:
    """From fractions of the whole to fractions of what a node holds."""
    return [((a - begin) / (end - begin), (b - begin) / (end - begin)) for a, b in intersect(x, [(begin, end)])]
