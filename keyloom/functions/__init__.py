"""Scalar functions and a registry for user functions."""

from __future__ import annotations

from collections.abc import Callable
import hashlib
import inspect

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SLOTS = 16384


def hash_tag(key: Column) -> Column:
    """What stands in the first braces of a key, or the key if that is empty."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    return F.when(tag != "", tag).otherwise(key)


def key_slot(key: Column) -> Column:
    """CRC16 (polynomial 0x1021, start 0) of the key's hash tag, modulo 16384: the bytes are
    folded in column arithmetic."""
    digits = F.hex(F.encode(hash_tag(key), "UTF-8"))
    places = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2))).otherwise(F.array().cast("array<int>"))

    def step(crc: Column, at: Column) -> Column:
        byte = F.conv(F.substring(digits, at, F.lit(2)), 16, 10).cast("int")
        x = crc.bitwiseXOR(F.shiftleft(byte, 8))
        for _ in range(8):
            x = F.element_at(F.transform(F.array(x), lambda v: F.when(v.bitwiseAND(0x8000) != 0, F.shiftleft(v, 1).bitwiseXOR(0x1021)).otherwise(F.shiftleft(v, 1)).bitwiseAND(0xFFFF)), 1)
        return x

    return F.aggregate(places, F.lit(0), step) % SLOTS


class Library:
    """Named user functions: load, list, call and delete, on any session."""

    def __init__(self):
        self._functions: dict[str, tuple[Callable, str, bool]] = {}

    def load(self, name: str, f: Callable, returns: str, read_only: bool = True, replace: bool = False) -> None:
        if name in self._functions and not replace:
            raise ValueError(f"function {name} exists")
        self._functions[name] = (f, returns, read_only)

    def names(self) -> list[str]:
        return sorted(self._functions)

    def delete(self, name: str) -> None:
        del self._functions[name]

    def call(self, name: str, *columns: Column, read_only: bool = False) -> Column:
        f, returns, safe = self._functions[name]
        if read_only and not safe:
            raise ValueError(f"function {name} may write")
        return F.pandas_udf(f, returns)(*columns)

    def register(self, spark: SparkSession) -> None:
        for name, (f, returns, _) in self._functions.items():
            spark.udf.register(name, F.pandas_udf(f, returns))


class Scripts:
    """User functions known by the sha1 of their source: what was run once can be called by
    that digest alone."""

    def __init__(self):
        self._known: dict[str, tuple[Callable, str]] = {}

    @staticmethod
    def digest(f: Callable) -> str:
        return hashlib.sha1(inspect.getsource(f).encode()).hexdigest()

    def load(self, f: Callable, returns: str) -> str:
        sha = self.digest(f)
        self._known[sha] = f, returns
        return sha

    def exists(self, *digests: str) -> list[bool]:
        return [d.lower() in self._known for d in digests]

    def flush(self) -> None:
        self._known.clear()

    def call(self, digest: str, *columns: Column) -> Column:
        if digest.lower() not in self._known:
            raise KeyError(f"no script {digest}")
        f, returns = self._known[digest.lower()]
        return F.pandas_udf(f, returns)(*columns)

    def run(self, f: Callable, returns: str, *columns: Column) -> Column:
        return self.call(self.load(f, returns), *columns)
