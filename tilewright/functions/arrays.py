"""Columns over tiles held as arrays of doubles: all stay in the JVM and need no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Norms at most this large count as zero.
TINY = 1e-12


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def let(value: Column, f) -> Column:
    """``f(value)`` with the value computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def norm(c: Column) -> Column:
    """L2 norm."""
    return F.sqrt(F.aggregate(c, F.lit(0.0), lambda a, e: a + e * e))


def amplitudes(c: Column) -> Column:
    """struct(amps, norm): unit amplitudes; zeros and norm 0 where the norm is tiny. Lengths must be powers of two."""
    return let(
        norm(c),
        lambda n: F.struct(F.transform(c, lambda e: F.when(n > TINY, e / n).otherwise(0.0)).alias("amps"), F.when(n > TINY, n).otherwise(0.0).alias("norm")),
    )


def with_ancilla(c: Column) -> Column:
    """The tensor product with an ancilla in |+>."""
    return F.flatten(F.transform(c, lambda e: F.array(e / math.sqrt(2), e / math.sqrt(2))))


def decremented(c: Column) -> Column:
    """new[k] = old[k + 1], cyclically."""
    return let(c, lambda a: F.concat(F.slice(a, F.lit(2), F.size(a) - 1), F.slice(a, F.lit(1), F.lit(1))))


def ancilla_hadamard(c: Column) -> Column:
    """Hadamard on the lowest qubit."""

    def pairs(a: Column) -> Column:
        even, odd = F.filter(a, lambda _, i: i % 2 == 0), F.filter(a, lambda _, i: i % 2 == 1)
        return F.flatten(F.zip_with(even, odd, lambda e, o: F.array((e + o) / math.sqrt(2), (e - o) / math.sqrt(2))))

    return let(c, pairs)


def statevector(amps: Column) -> Column:
    """The state before measuring: ancilla, decrement, Hadamard."""
    return ancilla_hadamard(decremented(with_ancilla(amps)))


def cyclic_differences(c: Column) -> Column:
    """c[i] - c[i + 1], cyclically: the odd amplitudes times 2 and the norm, without the doubled state."""
    return F.zip_with(c, decremented(c), lambda a, b: a - b)


def differences_from_state(state: Column, n: Column) -> Column:
    """The same from a statevector."""
    return F.transform(F.filter(state, lambda _, i: i % 2 == 1), lambda a: a * 2 * n)


def transposed(c: Column, t: int) -> Column:
    """A t x t tile with rows and columns exchanged."""
    return F.transform(F.sequence(F.lit(0), F.lit(t * t - 1)), lambda i: F.get(c, ((i % t) * t + F.floor(i / t)).cast("int")))


def core(c: Column, t: int, of) -> Column:
    """``of(pixel, right neighbour, lower neighbour)`` over the (t-1) x (t-1) core of a tile."""
    s = t - 1

    def at(i: Column) -> Column:
        k = (F.floor(i / s) * t + i % s).cast("int")
        return of(F.get(c, k), F.get(c, k + 1), F.get(c, k + t))

    return F.transform(F.sequence(F.lit(0), F.lit(s * s - 1)), at)


def magnitude(c: Column, t: int) -> Column:
    """Edge magnitude of a tile's core."""
    return core(c, t, lambda p, r, d: F.sqrt((p - r) * (p - r) + (p - d) * (p - d)))


def next_power_of_two(n: Column) -> Column:
    return F.when(n <= 1, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1), F.length(F.bin((n - 1).cast("long"))).cast("int")))


def padded_to_power_of_two(c: Column) -> Column:
    missing = (next_power_of_two(F.size(c)) - F.size(c)).cast("int")
    return F.concat(c, F.when(missing > 0, F.transform(F.sequence(F.lit(1), F.greatest(missing, F.lit(1))), lambda _: F.lit(0.0))).otherwise(F.array().cast("array<double>")))


def data_qubits(n: Column) -> Column:
    """log2 of a power of two; raises for anything else."""
    return F.when((n >= 2) & (F.bit_count(n) == 1), F.length(F.bin(n.cast("long"))) - 1).otherwise(F.raise_error(F.lit("not a power of two")).cast("int"))


def has_unit_norm(c: Column, tolerance: float = 1e-7) -> Column:
    return F.abs(norm(c) - 1) <= tolerance


def index_of(y: Column, x: Column, height: int, width: int) -> Column:
    inside = (y >= 0) & (y < height) & (x >= 0) & (x < width)
    return F.when(inside, y * width + x).otherwise(F.raise_error(F.lit("outside of the image")).cast("int"))


def coordinates_of(k: Column, height: int, width: int) -> Column:
    inside = (k >= 0) & (k < height * width)
    return F.when(inside, F.struct(F.floor(k / width).cast("int").alias("y"), (k % width).alias("x"))).otherwise(F.raise_error(F.lit("outside of the image")).cast("struct<y:int,x:int>"))


def dominant(re: Column, im: Column) -> Column:
    """The place of the largest |amplitude|, the first of equals."""
    size = F.zip_with(re, im, lambda a, b: F.round(a * a + b * b, 12))
    return (F.array_position(size, F.array_max(size)) - 1).cast("int")


def real_state(re: Column, im: Column) -> Column:
    """A state that is real up to a global phase, without it; its sign is such that the even amplitudes' sum isn't negative."""

    def turned(k: Column) -> Column:
        def by(a: Column, b: Column) -> Column:
            size = F.sqrt(a * a + b * b)
            c, d = F.when(size > 0, a / size).otherwise(1.0), F.when(size > 0, b / size).otherwise(0.0)
            return F.zip_with(re, im, lambda x, y: x * c + y * d)

        return by(F.get(re, k), F.get(im, k))

    def signed(s: Column) -> Column:
        even = F.aggregate(F.filter(s, lambda _, i: i % 2 == 0), F.lit(0.0), lambda a, e: a + e)
        return F.transform(s, lambda v: F.when(even < 0, -v).otherwise(v))

    return let(let(dominant(re, im), turned), signed)
