"""Keyed Feistel permutation of [0, n) with cycle walking, as Spark columns and as numpy arrays.

A value of ``bits`` bits (the fewest that hold n - 1, two at least) is cut into a left and a right part.
Each round swaps the parts and adds a keyed mix of one to the other, so every round can be undone. A result
of n or more goes through the permutation again until it falls below n: since 2**bits < 2n, half of the values
at least need no second walk, and the walk ends because the permutation's cycles return to their start.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 6
_P = 2**31 - 1
#: Walks in one row's expression; more raise an error rather than give a wrong slot (chance below 2**-512).
_WALKS = 512


def round_constants(key: int) -> list[tuple[int, int, int]]:
    """Three constants below 2**31 - 1 for each round, drawn from the key by splitmix64."""
    state, out = key % 2**64, []
    for _ in range(ROUNDS):
        three = []
        for _ in range(3):
            state = (state + 0x9E3779B97F4A7C15) % 2**64
            z = state
            z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
            z = (z ^ (z >> 27)) * 0x94D049BB133111EB % 2**64
            three.append((z ^ (z >> 31)) % (_P - 1) + 1)
        out.append(tuple(three))
    return out


def _once(x: Column, bits: Column, key: int) -> Column:
    power = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n)
    low = (bits / 2).cast("int")
    high = bits - low
    start = F.struct(
        F.call_function("shiftright", x, low).alias("l"),
        x.bitwiseAND(power(low) - 1).alias("r"),
        high.alias("wl"),
        low.alias("wr"),
    )
    keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(n) for n, v in zip("abc", k)]) for k in round_constants(key)])

    def step(s: Column, k: Column) -> Column:
        t = (F.pmod(s["r"], F.lit(_P)) * k["a"] + k["b"]) % _P
        t = (t * t + k["c"]) % _P
        mixed = s["l"].bitwiseXOR(t.bitwiseAND(power(s["wl"]) - 1))
        return F.struct(s["r"].alias("l"), mixed.alias("r"), s["wr"].alias("wl"), s["wl"].alias("wr"))

    end = F.aggregate(keys, start, step)
    return F.transform(F.array(end), lambda s: F.call_function("shiftleft", s["l"], s["wr"]) + s["r"])[0]


def permute(x: Column, n: Column, key: int) -> Column:
    """Slot of row number ``x`` (long) among ``n`` (long, 1 or more, below 2**61)."""
    bits = F.greatest(F.length(F.bin(n - 1)), F.lit(2))
    walked = F.aggregate(
        F.sequence(F.lit(1), F.lit(_WALKS)),
        _once(x, bits, key),
        lambda y, _: F.when(y < n, y).otherwise(_once(y, bits, key)),
    )
    return F.when(n == 1, F.lit(0).cast("long")).otherwise(walked)


def permute_array(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """The same slots for a numpy array of row numbers."""
    x = np.asarray(x, np.int64)
    if n <= 1:
        return np.zeros_like(x)
    bits = max((n - 1).bit_length(), 2)
    low = bits // 2
    keys = round_constants(key)

    def once(v: np.ndarray) -> np.ndarray:
        left, right, wl, wr = v >> low, v & ((1 << low) - 1), bits - low, low
        for a, b, c in keys:
            t = (right % _P * a + b) % _P
            t = (t * t + c) % _P
            left, right, wl, wr = right, left ^ (t & ((1 << wl) - 1)), wr, wl
        return (left << wr) + right

    out = once(x)
    while (over := out >= n).any():
        out[over] = once(out[over])
    return out
