"""A keyed permutation of a fixed identifier domain, as a Catalyst expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Identifiers live in [0, 2**DOMAIN_BITS); an even number of bits, so that both halves are equal.
DOMAIN_BITS = 48
ROUNDS = 6


def feistel(ident: Column, *key: Column | int | str, bits: int = DOMAIN_BITS, rounds: int = ROUNDS) -> Column:
    """The place of an identifier under the permutation chosen by the key; null outside [0, 2**bits) and for null.

    A balanced Feistel network: each round adds a keyed hash of one half to the other, so the map is one to one on the
    domain whatever the hash does. It needs no state, no sort and no shuffle, and one row's value never depends on
    another row.
    """
    if bits % 2 or not 2 <= bits <= 62:
        raise ValueError("bits must be even and between 2 and 62")
    half = bits // 2
    mask = (1 << half) - 1
    keys = [k if isinstance(k, Column) else F.lit(k) for k in key]
    inside = (ident >= 0) & (ident < (1 << bits))
    state = F.struct(F.shiftright(ident.cast("bigint"), half).alias("l"), ident.cast("bigint").bitwiseAND(mask).alias("r"))
    # aggregate() evaluates each round once; nesting the expressions would double the work with every round
    mixed = F.aggregate(
        F.array(*[F.lit(k) for k in range(rounds)]),
        state,
        lambda s, k: F.struct(
            s["r"].alias("l"),
            s["l"].bitwiseXOR(F.xxhash64(s["r"], k, *keys).bitwiseAND(mask)).alias("r"),
        ),
        lambda s: F.shiftleft(s["l"], half).bitwiseOR(s["r"]),
    )
    return F.when(inside, mixed)


def under_rate(place: Column, rate: Column | float, bits: int = DOMAIN_BITS) -> Column:
    """Whether a permuted value lies under rate x domain size."""
    rate = rate if isinstance(rate, Column) else F.lit(float(rate))
    return place < F.floor(F.least(F.greatest(rate, F.lit(0.0)), F.lit(1.0)) * F.lit(float(1 << bits))).cast("bigint")
