"""Primes, slots, schedules and reproducible uniform numbers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Samples of a mini-epoch (fixed value).
SAMPLES_PER_EPOCH = 40320
#: Modulus of the mixing function: prime and 2 modulo 3, so that cubing permutes its residues.
MODULUS = 2147483579


def is_prime(n: int) -> bool:
    if n < 2:
        return False
    return all(n % d for d in range(2, math.isqrt(n) + 1))


def is_prime_column(n: Column) -> Column:
    """Trial division as an expression; only for numbers of moderate size."""
    root = F.floor(F.sqrt(n.cast("double"))).cast("bigint")
    return (n >= 2) & ((n < 4) | F.forall(F.sequence(F.lit(2).cast("bigint"), F.greatest(root, F.lit(2))), lambda d: n % d != 0))


def magic_prime(slots: int, floor: float = 0.9) -> int:
    """Largest prime up to ``slots`` that is 2 modulo 3 and above ``floor`` of it; an error if there is none."""
    for p in range(slots, int(floor * slots), -1):
        if p % 3 == 2 and is_prime(p):
            return p
    raise ValueError(f"no prime that is 2 modulo 3 in the top of {slots} slots")


def check_prime(p: int, slots: int, floor: float = 0.9) -> bool:
    """Errors on a prime that breaks the permutation or cannot hold an epoch; False means coverage is low."""
    if not is_prime(p) or p % 3 != 2:
        raise ValueError(f"{p} is no prime that is 2 modulo 3")
    if p > slots:
        raise ValueError(f"{p} exceeds the {slots} slots")
    if p < SAMPLES_PER_EPOCH:
        raise ValueError(f"{p} is below the samples of an epoch")
    return p / slots > floor


def sample_number(epoch: Column, idx: Column, rank: Column, world: int) -> Column:
    return F.lit(1) + epoch * SAMPLES_PER_EPOCH + idx * world + rank


def slot_factor(p: int) -> int:
    return int(p * ((math.sqrt(5) - 1) / 2))


def slot(ii: Column, p: int) -> Column:
    """``factor * ii ** 3 mod p``, reduced after each product so that no bigint overflows."""
    r = ii % p
    return (F.lit(slot_factor(p)).cast("bigint") * (((r * r) % p * r) % p)) % p


def uniform(doc: Column, epoch: int | Column, pos: Column, salt: int) -> Column:
    """A reproducible uniform number in [0, 1) of a document, epoch and position."""
    h = (doc.cast("bigint") * 1000003 + (epoch if isinstance(epoch, Column) else F.lit(epoch)).cast("bigint") * 7919 + pos.cast("bigint") * 104729 + salt) % MODULUS
    for i in range(2):
        h = ((h * h % MODULUS) * h + 12345 + i) % MODULUS
    return h / F.lit(float(MODULUS))


def uniform_array(doc, epoch: int, pos, salt: int) -> np.ndarray:
    """The same with numpy."""
    h = (np.asarray(doc, np.int64) * 1000003 + epoch * 7919 + np.asarray(pos, np.int64) * 104729 + salt) % MODULUS
    for i in range(2):
        h = ((h * h % MODULUS) * h + 12345 + i) % MODULUS
    return h / float(MODULUS)


def sql_uniform(doc: str, epoch: str, pos: str, salt: int) -> str:
    """The same as DuckDB SQL."""
    h = f"(({doc}) * 1000003 + ({epoch}) * 7919 + ({pos}) * 104729 + {salt}) % {MODULUS}"
    for i in range(2):
        h = f"list_transform([{h}], lambda h: (((h * h) % {MODULUS}) * h + {12345 + i}) % {MODULUS})[1]"
    return f"({h} / {float(MODULUS)})"


def learning_rate(step: Column, warmup: int, ctx_len: int, batch: int, exit_tokens: int, initial: float, final: float) -> Column:
    """Linear warm-up times cosine decay to ``final``; only positive ``exit_tokens`` have a defined rate."""
    if exit_tokens <= 0:
        raise ValueError("exit_tokens must be positive")
    tokens = step * (ctx_len * batch)
    begun = warmup * ctx_len * batch
    progress = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (tokens - begun) / F.lit(float(exit_tokens - begun))))
    ratio = final / initial
    rate = initial * ((0.5 + ratio / 2) + (0.5 - ratio / 2) * F.cos(F.lit(math.pi) * progress))
    return F.when(step < warmup, rate * (0.01 + 0.99 * step / F.lit(float(max(warmup, 1))))).otherwise(rate)


def resized(values: Column, size: int) -> Column:
    """A weight vector resized to ``size`` by linear interpolation."""
    n = F.size(values)

    def at(i: Column) -> Column:
        pos = i / F.lit(float(size)) * n
        low = F.floor(pos).cast("int")
        part = pos - low
        between = F.element_at(values, low + 1) * (1 - part) + F.element_at(values, F.least(low + 2, n)) * part
        return F.when(pos >= n - 1, F.element_at(values, n)).otherwise(between)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), at)
