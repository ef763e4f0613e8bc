"""Numbers, vectors, hashes and dates as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DUE_DAYS = {"unsolved": 0, "shown": 0, "heavy": 2, "hinted": 7, "clean": 21}
STATUSES = tuple(DUE_DAYS)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def normalize(a: Column) -> Column:
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(a, lambda x: x.cast("double") / n)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def grade(x: Column) -> Column:
    """Rounded half to even and clipped to 1..10."""
    return clamp(F.rint(x), 1.0, 10.0)


def cap_value(x: Column) -> Column:
    """A cap from outside: junk and negatives count as 0."""
    return F.greatest(F.lit(0), F.coalesce(x.try_cast("int"), F.lit(0)))


def expected_grade(logits: Column) -> Column:
    """1 plus the softmax expectation of the index."""
    top = F.array_max(logits)
    weights = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda s, x: s + x)
    return F.lit(1.0) + F.aggregate(F.transform(weights, lambda w, i: w * i), F.lit(0.0), lambda s, x: s + x) / total


def interpolate(raw: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation at ascending knots, clipped at both ends; at equal knots the later value."""
    knots = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in zip(xs, ys)])
    above = F.filter(F.sequence(F.lit(2), F.lit(len(xs))), lambda i: F.element_at(knots, i)["x"] >= raw)
    i = F.try_element_at(above, F.lit(1))
    low, high = F.try_element_at(knots, i - 1), F.try_element_at(knots, i)
    inner = F.when(high["x"] == low["x"], high["y"]).otherwise(low["y"] + (raw - low["x"]) * (high["y"] - low["y"]) / F.nullif(high["x"] - low["x"], F.lit(0.0)))
    return F.when(raw <= xs[0], F.lit(float(ys[0]))).when(raw >= xs[-1], F.lit(float(ys[-1]))).otherwise(inner)


def bin_of(x: Column, edges: Column) -> Column:
    """How many edges are at or below x."""
    return F.size(F.filter(edges, lambda e: e <= x))


def fingerprint(*parts: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, length)


def hash_order(seed: int, key: Column) -> Column:
    """A seeded order of keys that any engine reproduces."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_slot(token: Column, slots: int = 64) -> Column:
    """Slot of a token by the last byte of its digest; slots divides 256."""
    return (F.conv(F.right(F.md5(token), F.lit(2)), 16, 10).cast("int") % slots).cast("int")


def attempt_status(outcome: Column, hint_max: Column) -> Column:
    return F.when(outcome != "solved", outcome).when(hint_max.isNull(), "clean").when(hint_max >= 3, "heavy").otherwise("hinted")


def due_at(finished: Column, status: Column, now: Column) -> Column:
    days = F.coalesce(*[F.when(status == k, v) for k, v in DUE_DAYS.items()])
    return F.coalesce(finished + F.make_interval(days=days), now)


def minutes_left(seconds: Column) -> Column:
    return F.ceil(seconds / 60).cast("int")
