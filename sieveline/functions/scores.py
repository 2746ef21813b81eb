"""Ratios of a confusion's four counts; each is null where it is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNTS = ("tp", "fp", "fn", "tn")


def confusion(truth: Column, predicted: Column, weight: Column | None = None) -> list[Column]:
    """The four counts as aggregates; rows without a truth or a prediction don't count. With `weight`, sums of it."""
    cells = {"tp": truth & predicted, "fp": ~truth & predicted, "fn": truth & ~predicted, "tn": ~truth & ~predicted}
    if weight is None:
        return [F.count_if(c).alias(k) for k, c in cells.items()]
    return [F.sum(F.when(c, weight).otherwise(0)).alias(k) for k, c in cells.items()]


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def precision() -> Column:
    return F.try_divide(_d("tp"), _d("tp") + _d("fp"))


def recall() -> Column:
    return F.try_divide(_d("tp"), _d("tp") + _d("fn"))


def f1() -> Column:
    return F.try_divide(2 * precision() * recall(), precision() + recall())


def accuracy() -> Column:
    return F.try_divide(_d("tp") + _d("tn"), _d("tp") + _d("fp") + _d("fn") + _d("tn"))


def mcc() -> Column:
    margins = (_d("tp") + _d("fp")) * (_d("tp") + _d("fn")) * (_d("tn") + _d("fp")) * (_d("tn") + _d("fn"))
    return F.try_divide(_d("tp") * _d("tn") - _d("fp") * _d("fn"), F.sqrt(margins))


def cohen_kappa() -> Column:
    n = _d("tp") + _d("fp") + _d("fn") + _d("tn")
    seen = F.try_divide(_d("tp") + _d("tn"), n)
    chance = F.try_divide((_d("tp") + _d("fp")) * (_d("tp") + _d("fn")) + (_d("tn") + _d("fn")) * (_d("tn") + _d("fp")), n * n)
    return F.try_divide(seen - chance, 1 - chance)


def all_scores(digits: int = 6) -> list[Column]:
    return [F.round(c, digits).alias(k) for k, c in (("precision", precision()), ("recall", recall()), ("f1", f1()), ("accuracy", accuracy()), ("mcc", mcc()))]


def wilson(good: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The interval's ends; (0, 1) without trials."""
    n_ = n.cast("double")
    p = F.try_divide(good.cast("double"), n_)
    centre = F.try_divide(p + z * z / (2 * F.when(n_ > 0, n_)), 1 + z * z / F.when(n_ > 0, n_))
    half = F.try_divide(z * F.sqrt(p * (1 - p) / F.when(n_ > 0, n_) + z * z / (4 * F.when(n_ > 0, n_ * n_))), 1 + z * z / F.when(n_ > 0, n_))
    return F.coalesce(F.greatest(centre - half, F.lit(0.0)), F.lit(0.0)), F.coalesce(F.least(centre + half, F.lit(1.0)), F.lit(1.0))
