"""Semirings as column algebra: plus is a built-in aggregate, times a column expression.

Each ring also has the scalar operations, for tests and for values on the driver."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Semiring:
    """A commutative semiring over one column type.

    zero and one are its identities, type the weights' Spark type. better orders weights for k-best: the larger or the
    smaller comes first. tolerance bounds the difference of weights that count as equal."""

    name = ""
    type = "double"
    zero: object = 0.0
    one: object = 1.0
    descending = True
    idempotent = False
    tolerance = 1e-10

    def lit(self, value: object) -> Column:
        return F.lit(value).cast(self.type)

    def times(self, a: Column, b: Column) -> Column:
        raise NotImplementedError

    def divide(self, d: Column, w: Column) -> Column:
        """d to the power of minus one, times w."""
        raise NotImplementedError

    def closure(self, a: Column) -> Column:
        raise NotImplementedError

    def is_zero(self, a: Column) -> Column:
        return a == self.lit(self.zero)

    def close(self, a: Column, b: Column) -> Column:
        return (a == b) | (F.abs(a - b) <= self.tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b)))

    def sum(self, df: DataFrame, keys: list, weight: str = "weight") -> DataFrame:
        """df grouped by keys, with weight summed. Spark aggregates partially before the shuffle."""
        return df.groupBy(*keys).agg(self.total(F.col(weight)).alias(weight))

    def total(self, weight: Column) -> Column:
        raise NotImplementedError

    def rounded(self, a: Column, digits: int = 9) -> Column:
        """Weights that differ by noise only, as one value."""
        return F.round(a, digits) + F.lit(0.0)

    def plus_(self, a, b):
        raise NotImplementedError

    def times_(self, a, b):
        raise NotImplementedError

    def closure_(self, a):
        raise NotImplementedError

    def close_(self, a, b) -> bool:
        return a == b or abs(a - b) <= self.tolerance * max(1.0, abs(a), abs(b))

    def total_(self, values):
        return reduce(self.plus_, values, self.zero)

    #: Plus on numpy arrays, and times of arrays none of whose elements is zero.
    plus_array = staticmethod(np.add)
    times_array = staticmethod(np.add)

    def outer_(self, column: np.ndarray, row: np.ndarray) -> np.ndarray:
        """All products of a column's and a row's elements; zero wins, over infinities as well."""
        full = np.full((len(column), len(row)), self.zero, dtype=np.bool_ if self.type == "boolean" else np.float64)
        i, j = np.flatnonzero(column != self.zero), np.flatnonzero(row != self.zero)
        full[np.ix_(i, j)] = self.times_array(column[i][:, None], row[j][None, :])
        return full

    def closed_(self, a: np.ndarray) -> np.ndarray:
        """The sum of all powers of a square matrix: states are eliminated one by one, each with the closure of its own loop."""
        a = a.copy()
        for p in range(len(a)):
            loop = np.array([self.closure_(a[p, p].item())], dtype=a.dtype)
            way = self.outer_(a[:, p], loop)[:, 0]
            a = self.plus_array(a, self.outer_(way, a[p]))
        own = np.arange(len(a))
        a[own, own] = self.plus_array(a[own, own], np.array(self.one, dtype=a.dtype))
        return a


    def closed_all_(self, a: np.ndarray) -> np.ndarray:
        """closed_ of each of many square matrices of one size, all at once."""

        def product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            with np.errstate(all="ignore"):
                return np.where((x != self.zero) & (y != self.zero), self.times_array(x, y), self.zero)

        a, own = a.copy(), np.arange(a.shape[1])
        for p in own:
            loop = np.array([self.closure_(x) for x in a[:, p, p].tolist()], dtype=a.dtype)[:, None]
            a = self.plus_array(a, product(product(a[:, :, p], loop)[:, :, None], a[:, p, None, :]))
        a[:, own, own] = self.plus_array(a[:, own, own], np.array(self.one, dtype=a.dtype))
        return a


class Boolean(Semiring):
    name, type, zero, one, idempotent = "boolean", "boolean", False, True, True
    plus_array, times_array = staticmethod(np.logical_or), staticmethod(np.logical_and)

    def times(self, a, b):
        return a & b

    def divide(self, d, w):
        return w

    def closure(self, a):
        return F.lit(True)

    def close(self, a, b):
        return a == b

    def total(self, weight):
        return F.bool_or(weight)

    def rounded(self, a, digits=9):
        return a

    def plus_(self, a, b):
        return a or b

    def times_(self, a, b):
        return a and b

    def closure_(self, a):
        return True

    def close_(self, a, b):
        return a == b


class Probability(Semiring):
    name = "probability"
    times_array = staticmethod(np.multiply)

    def times(self, a, b):
        return a * b

    def divide(self, d, w):
        return F.try_divide(w, d)

    def closure(self, a):
        return F.when(a < 1, F.try_divide(F.lit(1.0), 1 - a)).otherwise(F.lit(math.inf))

    def total(self, weight):
        return F.sum(weight)

    def plus_(self, a, b):
        return a + b

    def times_(self, a, b):
        return a * b

    def closure_(self, a):
        return 1 / (1 - a) if a < 1 else math.inf


class Log(Semiring):
    """Probabilities as natural logarithms. The sum is a log-sum-exp in two aggregates: weights are summed within bands of
    BAND, scaled to their band, and a group's two largest bands then to the larger; neither step can overflow."""

    name, zero, one = "log", -math.inf, 0.0
    BAND = 512
    plus_array = staticmethod(np.logaddexp)

    def times(self, a, b):
        return F.when((a == -math.inf) | (b == -math.inf), F.lit(-math.inf)).otherwise(a + b)

    def divide(self, d, w):
        return F.when(w == -math.inf, F.lit(-math.inf)).otherwise(w - d)

    def closure(self, a):
        return F.when(a < 0, -F.log1p(-F.exp(a))).otherwise(F.lit(math.inf))

    def close(self, a, b):
        finite = (a > -math.inf) & (b > -math.inf)
        return (a == b) | (finite & (F.abs(a - b) <= self.tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))))

    def sum(self, df, keys, weight="weight"):
        w = F.col(weight)
        live = df.withColumn("__band", F.when(w > -math.inf, F.floor(w / self.BAND)))
        scaled = F.sum(F.when(F.col("__band").isNull(), F.lit(0.0)).otherwise(F.exp(w - F.col("__band") * self.BAND)))
        names = [F.col(k) if isinstance(k, str) else k for k in keys]
        bands = live.groupBy(*names, "__band").agg(scaled.alias("__sum"))
        value = F.when(F.col("__band").isNull(), F.lit(-math.inf)).otherwise(F.log("__sum") + F.col("__band") * self.BAND)
        kept = [k if isinstance(k, str) else bands.columns[i] for i, k in enumerate(keys)]
        # A band two below another adds less than exp(-BAND) of it: the largest even and the largest odd band are enough.
        highest = lambda odd: F.max_by(F.when(F.pmod("__band", F.lit(2)) == odd, F.col("__v")), F.when(F.pmod("__band", F.lit(2)) == odd, F.col("__band")))
        grouped = bands.select(*kept, "__band", value.alias("__v")).groupBy(*kept).agg(highest(0).alias("__a"), highest(1).alias("__b"))
        top, low = F.greatest("__a", "__b"), F.least("__a", "__b")  # both leave nulls out
        return grouped.select(*kept, F.when(top.isNull() | (top == -math.inf), F.lit(-math.inf)).when(low == top, top + F.when(F.col("__a").isNull() | F.col("__b").isNull(), F.lit(0.0)).otherwise(F.log(F.lit(2.0)))).otherwise(top + F.log1p(F.exp(low - top))).alias(weight))

    def rounded(self, a, digits=9):
        return F.when(a == -math.inf, a).otherwise(F.round(a, digits) + F.lit(0.0))

    def plus_(self, a, b):
        top = max(a, b)
        return top if top == -math.inf else top + math.log(math.exp(a - top) + math.exp(b - top))

    def times_(self, a, b):
        return a + b

    def closure_(self, a):
        return -math.log1p(-math.exp(a)) if a < 0 else math.inf


class Tropical(Semiring):
    name, zero, one, descending, idempotent = "tropical", math.inf, 0.0, False, True
    plus_array = staticmethod(np.minimum)

    def times(self, a, b):
        return a + b

    def divide(self, d, w):
        return F.when(w == math.inf, F.lit(math.inf)).otherwise(w - d)

    def closure(self, a):
        return F.when(a >= 0, F.lit(0.0)).otherwise(F.lit(-math.inf))

    def close(self, a, b):
        finite = (a < math.inf) & (b < math.inf)
        return (a == b) | (finite & (F.abs(a - b) <= self.tolerance * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))))

    def total(self, weight):
        return F.min(weight)

    def rounded(self, a, digits=9):
        return F.when(a == math.inf, a).otherwise(F.round(a, digits) + F.lit(0.0))

    def plus_(self, a, b):
        return min(a, b)

    def times_(self, a, b):
        return a + b

    def closure_(self, a):
        return 0.0 if a >= 0 else -math.inf


class Best(Semiring):
    """Another ring with the better of two weights for their sum: distances in it are those of the single best way."""

    idempotent = True

    def __init__(self, ring: Semiring):
        self.ring, self.name = ring, f"best {ring.name}"
        self.type, self.zero, self.one, self.descending, self.tolerance = ring.type, ring.zero, ring.one, ring.descending, ring.tolerance
        self.plus_array, self.times_array = np.maximum if ring.descending else np.minimum, ring.times_array

    def times(self, a, b):
        return self.ring.times(a, b)

    def divide(self, d, w):
        return self.ring.divide(d, w)

    def close(self, a, b):
        return self.ring.close(a, b)

    def rounded(self, a, digits=9):
        return self.ring.rounded(a, digits)

    def total(self, weight):
        return F.max(weight) if self.descending else F.min(weight)

    def closure(self, a):
        gains = a > self.lit(self.one) if self.descending else a < self.lit(self.one)
        return F.when(gains, self.lit(math.inf if self.descending else -math.inf)).otherwise(self.lit(self.one))

    def plus_(self, a, b):
        return max(a, b) if self.descending else min(a, b)

    def times_(self, a, b):
        return self.ring.times_(a, b)

    def closure_(self, a):
        gains = a > self.one if self.descending else a < self.one
        return self.one if not gains else math.inf if self.descending else -math.inf


BOOLEAN, PROBABILITY, LOG, TROPICAL = Boolean(), Probability(), Log(), Tropical()
RINGS = {r.name: r for r in (BOOLEAN, PROBABILITY, LOG, TROPICAL)}


def log_diff(a: Column, b: Column) -> Column:
    """log(exp(a) - exp(b)) for b at most a."""
    return F.when(b == -math.inf, a).when(a <= b, F.lit(-math.inf)).otherwise(a + F.log1p(-F.exp(b - a)))
