"""Hash functions as column expressions, by name.

A hasher maps a binary column to a binary key and knows the key's size. Users
register their own with :func:`register`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from quernstone.errors import InvalidInput


@dataclass(frozen=True)
class Hasher:
    name: str
    of: Callable[[Column], Column]
    #: Bytes of a key column's values.
    size: Callable[[Column], Column]


def _sha3(c: Column) -> Column:
    @F.arrow_udf("binary")
    def digest(v: pa.Array) -> pa.Array:
        return pa.array([None if x is None else hashlib.sha3_256(x).digest() for x in v.to_pylist()], pa.binary())

    return digest(c)


_KNOWN: dict[str, Hasher] = {}


def register(name: str, of: Callable[[Column], Column], size: int | None = None) -> Hasher:
    """Make a hasher known; ``size`` None takes the size of each key."""
    _KNOWN[name] = Hasher(name, of, (lambda c: F.octet_length(c).cast("long")) if size is None else (lambda c: F.lit(size).cast("long")))
    return _KNOWN[name]


register("sha256", lambda c: F.unhex(F.sha2(c, 256)), 32)
register("simple", lambda c: c)  # the payload is its own key: for tests and small chunks
register("sha3-256", _sha3, 32)
register("sha1", lambda c: F.unhex(F.sha1(c)), 20)
register("md5", lambda c: F.unhex(F.md5(c)), 16)


def hasher(name: str) -> Hasher:
    if name not in _KNOWN:
        raise InvalidInput(f"unknown hasher {name!r}; known: {', '.join(sorted(_KNOWN))}")
    return _KNOWN[name]


def ratio(a: Column, b: Column) -> Column:
    """Division of doubles with IEEE results for zero divisors."""
    a, b = a.cast("double"), b.cast("double")
    by_zero = F.when(a == 0, F.lit(float("nan"))).when(a.isNotNull(), F.lit(float("inf")))
    return F.when(b == 0, by_zero).otherwise(a / F.when(b != 0, b))
