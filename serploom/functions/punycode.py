"""Host labels outside ASCII in their ASCII spelling (RFC 3492), as folds over code points.

Labels are expected lower-cased and composed; the other full stops that may part labels count as dots.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the encoding (RFC 3492, section 5) and the four full stops (RFC 3490, section 3.1).
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_CODE = 36, 1, 26, 38, 700, 72, 128
FULL_STOPS = "[.。．｡]"

_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _digit(value: Column) -> Column:
    return F.substring(F.lit(_DIGITS), value.cast("int") + 1, F.lit(1))


def _number(delta: Column, bias: Column) -> Column:
    """A number in digits of growing weight: the thresholds come from the bias, the last digit lies below its own."""

    def step(state: Column, place: Column) -> Column:
        t = F.greatest(F.lit(T_MIN), F.least(F.lit(T_MAX), BASE * place - bias)).cast("bigint")
        last = state.left < t
        over = state.left - t
        digit = F.when(last, state.left).otherwise(t + over % (BASE - t))
        more = F.struct(
            F.when(last, F.lit(0)).otherwise(F.floor(over / (BASE - t))).cast("bigint").alias("left"), last.alias("done"),
            F.concat(state.text, _digit(digit)).alias("text"),
        )
        return F.when(state.done, state).otherwise(more)

    start = F.struct(delta.cast("bigint").alias("left"), F.lit(False).alias("done"), F.lit("").alias("text"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), start, step, lambda s: s.text)


def _bias(delta: Column, points: Column, first: Column) -> Column:
    """The bias after a number, from what it was and how many code points stand now."""
    damped = F.floor(delta / F.when(first, F.lit(DAMP)).otherwise(2)).cast("bigint")
    start = F.struct((damped + F.floor(damped / points)).cast("bigint").alias("left"), F.lit(0).cast("bigint").alias("k"))
    limit = ((BASE - T_MIN) * T_MAX) // 2

    def step(state: Column, _place: Column) -> Column:
        shorter = F.struct(F.floor(state.left / (BASE - T_MIN)).cast("bigint").alias("left"), (state.k + BASE).alias("k"))
        return F.when(state.left > limit, shorter).otherwise(state)

    def end(state: Column) -> Column:
        return (state.k + F.floor((BASE - T_MIN + 1) * state.left / (state.left + SKEW))).cast("bigint")

    return F.aggregate(F.sequence(F.lit(1), F.lit(8)), start, step, end)


def encode_label(label: Column) -> Column:
    """Bootstring form of one label: its ASCII characters, then each other one, smallest first, by how far it is from the last."""
    chars = F.filter(F.split(label, ""), lambda c: c != "")
    points = F.transform(chars, lambda c, i: F.struct(F.ascii(c).cast("bigint").alias("code"), i.cast("bigint").alias("place")))
    basic = F.array_join(F.filter(chars, lambda c: F.ascii(c) < FIRST_CODE), "")
    others = F.array_sort(F.filter(points, lambda p: p.code >= FIRST_CODE))

    def insert(state: Column, p: Column) -> Column:
        # what stands before it among the characters that are in place already
        before = F.size(F.filter(points, lambda q: (q.place < p.place) & (q.code <= p.code))).cast("bigint")
        delta = (p.code - state.code) * (state.length + 1) + before - state.at
        return F.struct(
            p.code.alias("code"), (before + 1).alias("at"), (state.length + 1).alias("length"),
            _bias(delta, state.length + 1, state.first).alias("bias"), F.lit(False).alias("first"),
            F.concat(state.text, _number(delta, state.bias)).alias("text"),
        )

    start = F.struct(
        F.lit(FIRST_CODE).cast("bigint").alias("code"), F.lit(0).cast("bigint").alias("at"), F.length(basic).cast("bigint").alias("length"),
        F.lit(FIRST_BIAS).cast("bigint").alias("bias"), F.lit(True).alias("first"), F.when(basic != "", F.concat(basic, F.lit("-"))).otherwise("").alias("text"),
    )
    return F.aggregate(others, start, insert, lambda s: s.text)


def ascii_labels(host: Column) -> Column:
    """A lower-case host with each label outside ASCII as ``xn--`` and its Bootstring form."""
    labels = F.split(host, FULL_STOPS)
    spelled = F.transform(labels, lambda x: F.when(F.length(x) == F.octet_length(x), x).otherwise(F.concat(F.lit("xn--"), encode_label(x))))
    return F.array_join(spelled, ".")


def is_foreign(host: Column) -> Column:
    """Whether anything lies outside ASCII: a comparison of two lengths, no pattern."""
    return F.length(host) != F.octet_length(host)
