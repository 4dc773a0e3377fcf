"""Vector math on ``array<float>`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _d(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product; both sides are widened before they are multiplied."""
    products = F.zip_with(_d(a), _d(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalized(a: Column | str) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(a)
    return F.transform(_d(a), lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 - cosine, within [0, 2]; 1 where either vector is zero."""
    n = norm(a) * norm(b)
    cos = F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), 1 - cos))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    squares = F.zip_with(_d(a), _d(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def category(v: Column | str, classes: int = 8) -> Column:
    """Position of the first largest magnitude, modulo ``classes``."""
    size = F.transform(_d(v), F.abs)
    return F.pmod(F.array_position(size, F.array_max(size)) - 1, F.lit(classes)).cast("int")


def terms(v: Column | str, n: int = 8) -> Column:
    """The n dimensions of largest magnitude as ``array<struct<term, weight>>``; the lower dimension wins a tie."""
    pairs = F.transform(_d(v), lambda x, i: F.struct((-F.abs(x.cast("double"))).alias("w"), i.cast("int").alias("term")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda p: F.struct(p.term.alias("term"), (-p.w).alias("weight")))


def quantize_int8(v: Column | str) -> Column:
    """Each component times 127, rounded half away from zero."""
    return F.transform(_d(v), lambda x: F.round(x.cast("double") * 127).cast("tinyint"))


def sign_bits(v: Column | str) -> Column:
    """Sign bits as text of 0 and 1, one for each component."""
    return F.array_join(F.transform(_d(v), lambda x: F.when(x >= 0, F.lit("1")).otherwise(F.lit("0"))), "")


def agreement(a: Column | str, b: Column | str) -> Column:
    """Share of components with the same sign."""
    same = F.zip_with(_d(a), _d(b), lambda x, y: F.when((x >= 0) == (y >= 0), F.lit(1)).otherwise(F.lit(0)))
    return F.aggregate(same, F.lit(0), lambda s, x: s + x) / F.size(_d(a))


def proxy_delta(now: Column | str, before: Column | str) -> Column:
    """Scaled distance to the vector before; 0 for the first."""
    squares = F.zip_with(_d(now), _d(before), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    total = F.aggregate(squares, F.lit(0.0), lambda s, x: s + x)
    return F.coalesce(F.sqrt(total / F.sqrt(F.size(_d(now)))), F.lit(0.0))


def softmax_entropy(v: Column | str) -> Column:
    """Entropy (nats) of the softmax of the components."""
    top = F.array_max(_d(v)).cast("double")
    e = F.transform(_d(v), lambda x: F.exp(x.cast("double") - top))
    z = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.aggregate(e, F.lit(0.0), lambda s, x: s - x / z * F.ln(x / z))
