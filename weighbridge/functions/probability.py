"""Distributions, confidences, intervals and correctness as column expressions.

Distributions are arrays aligned with the label order, so the first of equal maxima is well defined.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from weighbridge.functions.text import let

Z95 = 1.959963984540054  # two-sided 95% normal quantile
FLOOR = 1e-12  # smallest probability inside a logarithm


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))


def expected_labels(question: Column) -> Column:
    kind, options = question["type"], question["options"]
    return (
        F.when(kind == "noul", F.array(F.lit("0"), F.lit("1")))
        .when(kind == "score", F.transform(options, lambda _, i: i.cast("string")))
        .otherwise(F.transform(options, lambda o: o["key"]))
    )


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    t = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    mass = lambda l: let(F.array_max(l), lambda m: F.transform(l, lambda x: F.exp((x - m) / t)))
    return let(mass(logits), lambda e: let(total(e), lambda s: F.transform(e, lambda x: x / s)))


def argmax(p: Column) -> Column:
    """1-based position of the first maximum."""
    return F.array_position(p, F.array_max(p))


def choice_confidence(p: Column) -> Column:
    k = F.size(p).cast("double")
    return F.when(k == 1, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), (k * F.array_max(p) - 1) / F.nullif(k - 1, F.lit(0.0)))
    )


def score_confidence(p: Column) -> Column:
    k = F.size(p).cast("double")
    mode = (argmax(p) - 1).cast("double")
    spread = total(F.transform(p, lambda x, i: x * F.abs(i - mode)))
    uniform = total(F.transform(p, lambda _, i: F.abs(i - (k - 1) / 2))) / k
    return F.greatest(F.lit(0.0), 1 - spread / uniform)


def wilson_low(correct: Column, n: Column) -> Column:
    return _wilson(correct, n, -1)


def wilson_high(correct: Column, n: Column) -> Column:
    return _wilson(correct, n, 1)


def _wilson(correct: Column, n: Column, side: int) -> Column:
    z2 = Z95 * Z95
    n = F.when(n > 0, n.cast("double"))
    rate = correct / n
    scale = 1 + z2 / n
    mid = (rate + z2 / (2 * n)) / scale
    half = Z95 * F.sqrt(rate * (1 - rate) / n + z2 / (4 * n * n)) / scale
    return mid + side * half


def valid_probabilities(p: Column, extra_keys: Column, allow_rounding: bool = False) -> Column:
    """Struct(p, reason): p renormalised over the labels, or null with the reason.

    p holds one value per label (null where the answer lacks the key); extra_keys is true when the answer
    names a key that is no label.
    """
    # Values, their sum and the reason are bound once: a division per value must not add them all up again.
    def judged(v: Column) -> Column:
        bad = ~F.coalesce(F.forall(v, lambda x: finite(x) & (x >= 0) & (x <= 1)), F.lit(False))
        return let(total(v), lambda s: let(
            F.when(extra_keys | bad, F.lit("invalid probability keys or values")).when(
                (s <= 0) if allow_rounding else ((s <= 0) | (F.abs(s - 1) > 1e-6)), F.lit("probabilities do not sum to one")),
            lambda reason: F.struct(F.when(reason.isNull(), F.transform(v, lambda x: x / s)).alias("p"), reason.alias("reason"))))

    return let(p, judged)


def human_distribution(soft: Column, labels: Column) -> Column:
    """Struct(h, reason) from a map label -> votes; both null when there are no votes."""
    def judged(votes: Column) -> Column:
        return let(total(votes), lambda s: let(
            F.when(soft.isNull(), None)
            .when(F.size(F.array_except(F.map_keys(soft), labels)) > 0, F.lit("unexpected human-label key"))
            .when(~F.forall(votes, lambda x: finite(x) & (x >= 0)) | (s <= 0), F.lit("invalid human distribution")),
            lambda reason: F.struct(
                F.when(soft.isNotNull() & reason.isNull(), F.transform(votes, lambda x: x / s)).alias("h"), reason.alias("reason"))))

    return let(F.transform(labels, lambda k: F.coalesce(F.try_element_at(soft, k), F.lit(0.0))), judged)


def soft_label_map(number: Column, levels: Column, options: Column) -> Column:
    """The three vote encodings as one map: P(yes) as a number, levels as a list, options as a map."""
    by_level = F.map_from_arrays(F.transform(levels, lambda _, i: i.cast("string")), levels)
    return (
        F.when(options.isNotNull(), options)
        .when(levels.isNotNull(), by_level)
        .when(number.isNotNull(), F.create_map(F.lit("0"), 1 - number, F.lit("1"), number))
    )


def chosen(primitive: Column, answer_choice: Column, labels: Column, p: Column) -> Column:
    """The label an answer stands for; an exact yes/no tie is yes."""
    return (
        F.when(primitive == "noul", F.when(F.element_at(p, 2) >= 0.5, F.lit("1")).otherwise(F.lit("0")))
        .when(primitive == "choice", answer_choice)
        .otherwise(F.element_at(labels, argmax(p).cast("int")))
    )


def tvd(a: Column, b: Column) -> Column:
    """Half the L1 distance of two aligned distributions."""
    return 0.5 * total(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def approx_equal(a: Column, b: Column, tol: float = 1e-12) -> Column:
    """Numeric equality within tol, relative or absolute; two nulls are equal."""
    close = F.abs(a - b) <= F.greatest(F.lit(tol), tol * F.greatest(F.abs(a), F.abs(b)))
    return F.coalesce(close, F.lit(False)) | (a.isNull() & b.isNull())


def approx_equal_arrays(a: Column, b: Column, tol: float = 1e-12) -> Column:
    same = F.forall(F.arrays_zip(a.alias("a"), b.alias("b")), lambda z: approx_equal(z["a"], z["b"], tol))
    return (F.size(a) == F.size(b)) & same
