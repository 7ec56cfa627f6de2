"""Vector functions as column expressions, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product; the longer vector is cut to the shorter. Null if either is null."""
    n = F.least(F.size(a), F.size(b))
    both = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(both, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """Divided by its length; all NaN for a zero vector, as there is no direction."""
    # The length is bound once to a variable; written into the inner function it would be computed for every element.
    scaled = F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n == 0, F.lit(float("nan"))).otherwise(x.cast("double") / F.nullif(n, F.lit(0.0)))))
    return F.element_at(scaled, 1)


def masked_mean(hidden: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; ``hidden`` is an array of vectors. Null where no token counts."""
    kept = F.transform(F.filter(F.arrays_zip(hidden.alias("h"), mask.alias("m")), lambda t: t["m"] == 1), lambda t: t["h"])
    width = F.size(F.element_at(hidden, 1))
    total = F.transform(F.sequence(F.lit(1), width), lambda i: F.aggregate(kept, F.lit(0.0), lambda s, v: s + F.element_at(v, i.cast("int"))))
    return F.when(F.size(kept) > 0, F.transform(total, lambda x: x / F.size(kept)))
