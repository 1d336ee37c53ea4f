"""Label codes, signed values and the three-class softmax."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The headline placeholder a page shows before it has loaded.
PLACEHOLDER = "Loading…"

# Class code order is 0 Negative, 1 Neutral, 2 Positive; signed -1, 0, +1.
LABELS = ["Negative", "Neutral", "Positive"]
SIGNS = {"Negative": -1, "Neutral": 0, "Positive": 1}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def class_to_label(c) -> Column:
    """0/1/2 -> Negative/Neutral/Positive; anything else -> null."""
    c = _c(c)
    out = F.when(c == 0, F.lit(LABELS[0]))
    for i, name in enumerate(LABELS[1:], start=1):
        out = out.when(c == i, F.lit(name))
    return out


def label_to_class(c) -> Column:
    """negative/neutral/positive (any case) -> 0/1/2 as int; unknown -> null (P5)."""
    low = F.lower(F.trim(_c(c)))
    out = F.when(low == LABELS[0].lower(), F.lit(0))
    for i, name in enumerate(LABELS[1:], start=1):
        out = out.when(low == name.lower(), F.lit(i))
    return out.cast("int")


def label_to_sign(c) -> Column:
    """Negative/Neutral/Positive -> -1/0/+1; unknown -> null."""
    c = _c(c)
    out = F.when(c == LABELS[0], F.lit(SIGNS[LABELS[0]]))
    for name in LABELS[1:]:
        out = out.when(c == name, F.lit(SIGNS[name]))
    return out


def class_to_sign(c) -> Column:
    """0/1/2 -> -1/0/+1, unknown -> null: P4 and P6 in one, looked up once instead of nested tests."""
    signs = F.array(*[F.lit(SIGNS[name]) for name in LABELS])
    return F.get(signs, _c(c).cast("int"))


def softmax3(l0, l1, l2) -> tuple[Column, Column, Column]:
    """Softmax of three logits, shifted by the max for stability (M3)."""
    l0, l1, l2 = _c(l0), _c(l1), _c(l2)
    m = F.greatest(l0, l1, l2)
    e0, e1, e2 = F.exp(l0 - m), F.exp(l1 - m), F.exp(l2 - m)
    t = e0 + e1 + e2
    return e0 / t, e1 / t, e2 / t


def argmax3(p0, p1, p2) -> Column:
    """Index of the largest of three values; the lowest index wins ties (M3)."""
    p0, p1, p2 = _c(p0), _c(p1), _c(p2)
    return (F.when((p0 >= p1) & (p0 >= p2), F.lit(0))
            .when(p1 >= p2, F.lit(1))
            .otherwise(F.lit(2))).cast("int")
