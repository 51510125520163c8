"""Counter-based random numbers as column expressions.

A draw depends on (seed, tick, id, salt) only, so it is the same however the rows are
partitioned and whenever they are computed again. Everything stays in long
arithmetic without overflow: 32-bit products are formed from 16-bit limbs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .math import clamp

# Fixed values of the generators.
PHILOX_MULTIPLIER = 3529668003
PHILOX_KEY_STEP = 2654435769
PHILOX_ROUNDS = 10
TICK_STRIDE = 1000003
SECOND_NORMAL_SALT = 73856093
XORSHIFT_MIX = 73244475
XORSHIFT_SEED, XORSHIFT_TICK, XORSHIFT_ID, XORSHIFT_SALT = 1013904243, 374761393, 668265263, 2531011
MASK32 = (1 << 32) - 1


def as_long(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("long")


def _round(state: Column, key: Column) -> Column:
    """One Philox-2x32 round on a struct (a, b); a * M is formed from the halves of a."""
    a, b = state["a"], state["b"]
    high = F.shiftright(a, 16) * PHILOX_MULTIPLIER
    low = a.bitwiseAND(65535) * PHILOX_MULTIPLIER + F.shiftleft(high.bitwiseAND(65535), 16)
    upper = F.shiftright(high, 16) + F.shiftright(low, 32)
    return F.struct(upper.bitwiseXOR(key).bitwiseXOR(b).alias("a"), low.bitwiseAND(MASK32).alias("b"))


def uniform(seed, tick, agent_id, salt) -> Column:
    """Uniform in [0, 1) with 23 bits, by ten rounds of Philox-2x32."""
    counter = (as_long(tick) * TICK_STRIDE + as_long(salt)).bitwiseAND(MASK32)
    start = F.struct(counter.alias("a"), as_long(agent_id).bitwiseAND(MASK32).alias("b"))
    if isinstance(seed, Column):
        keys = F.transform(F.sequence(F.lit(0), F.lit(PHILOX_ROUNDS - 1)), lambda r: (as_long(seed) + r.cast("long") * PHILOX_KEY_STEP).bitwiseAND(MASK32))
    else:
        keys = F.array(*[F.lit((seed + r * PHILOX_KEY_STEP) & MASK32).cast("long") for r in range(PHILOX_ROUNDS)])
    return F.aggregate(keys, start, _round, lambda s: s["a"].bitwiseAND((1 << 23) - 1) / F.lit(float(1 << 23)))


def uniform_xorshift(seed, tick, agent_id, salt) -> Column:
    """Uniform in [0, 1) with six decimals, by xor-shifts and multiplications."""
    fold = lambda h: h.bitwiseXOR(F.shiftright(h, 16) % 65536) % (1 << 31)
    mix = lambda h: (h * XORSHIFT_MIX) % (1 << 31)
    h = as_long(seed) * XORSHIFT_SEED + as_long(tick) * XORSHIFT_TICK + as_long(agent_id) * XORSHIFT_ID + as_long(salt) * XORSHIFT_SALT
    h = fold(mix(fold(mix(fold(h)))))
    return (h % 1000000) / F.lit(1000000.0)


def normal(seed, tick, agent_id, salt, mean=0.0, std=1.0) -> Column:
    """Normal by Box and Muller from two uniforms."""
    u1 = uniform(seed, tick, agent_id, salt)
    u2 = uniform(seed, tick, agent_id, as_long(salt) + SECOND_NORMAL_SALT)
    z = F.sqrt(F.log(u1 + F.lit(1e-10)) * -2.0) * F.cos(F.lit(2 * math.pi) * u2)
    return z * std + mean


def normal_bounded(seed, tick, agent_id, salt, low, high, mean=0.0, std=1.0) -> Column:
    """Normal, clamped (not drawn again) to [low, high]."""
    return clamp(normal(seed, tick, agent_id, salt, mean, std), low, high)
