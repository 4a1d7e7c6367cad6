"""JSON documents: relation ``json_docs(key, doc)``, with the path subset ``.k ['k'] [i] [*]
.*`` (a negative index counts from the end).

Types, lengths and keys at one definite path, and scalars (``value``), compile to built-in
functions; whatever rewrites or prints a document, wildcards and negative indexes run in Arrow
batches. A command answers null where the path has no match, and where the document is null
or malformed (``valid`` tells them apart); a write leaves a malformed document as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"""\.(\*)|\.([A-Za-z0-9_-]+)|\[(\*)\]|\[(-?\d+)\]|\[(?:'([^']*)'|"([^"]*)")\]""")


def parse_path(path: str) -> list[str | int | None]:
    """Keys, indexes, and None for a wildcard."""
    text = "" if path in (".", "$") else path.removeprefix("$")
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"bad path: {path}")
        star, name, star2, index, quoted, double = m.groups()
        out.append(None if star or star2 else int(index) if index is not None else next(x for x in (name, quoted, double) if x is not None))
        at = m.end()
    return out


def find(doc, tokens: list) -> list[tuple[object, object, object]]:
    """(parent, key or index, value) of every match; the root has no parent."""
    level = [(None, None, doc)]
    for t in tokens:
        nxt = []
        for _, _, v in level:
            if t is None:
                nxt += [(v, k, x) for k, x in (v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ())]
            elif isinstance(t, int) and isinstance(v, list) and -len(v) <= t < len(v):
                nxt.append((v, t % len(v), v[t]))
            elif isinstance(t, str) and isinstance(v, dict) and t in v:
                nxt.append((v, t, v[t]))
        level = nxt
    return level


def dumps(value) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def loads(doc: str | None):
    """The document and whether it is one."""
    try:
        return (None, False) if doc is None else (json.loads(doc), True)
    except ValueError:
        return None, False


def valid(doc: Column) -> Column:
    """Whether a document that is not null can be parsed."""
    return F.when(doc.isNotNull(), F.try_parse_json(doc).isNotNull())


def definite(path: str) -> str | None:
    """The path as built-in readers take it; None if they cannot."""
    tokens = parse_path(path)
    if any(t is None or isinstance(t, int) and t < 0 or isinstance(t, str) and "'" in t for t in tokens):
        return None
    return "$" + "".join(f"[{t}]" if isinstance(t, int) else f"['{t}']" for t in tokens)


def _udf(kind: T.DataType, f: Callable):
    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for docs in parts:
            yield pd.Series([f(x) if fine else None for x, fine in map(loads, docs)], dtype=object)

    return run


TYPES = {dict: "object", list: "array", str: "string", bool: "boolean", int: "integer", float: "number", type(None): "null"}


def get(doc: Column, *paths: str, indent: int | None = None) -> Column:
    """One match bare, any other number as an array; several paths as an object."""
    tokens = {p: parse_path(p) for p in paths or ("$",)}

    def one(d, t):
        found = [v for _, _, v in find(d, t)]
        return found[0] if len(found) == 1 else found

    def read(d):
        values = {p: one(d, t) for p, t in tokens.items()}
        out = values if len(tokens) > 1 else next(iter(values.values()))
        return dumps(out) if indent is None else json.dumps(out, ensure_ascii=False, indent=indent)

    return _udf(T.StringType(), read)(doc)


def value(doc: Column, path: str) -> Column:
    """A scalar at a definite path, by the built-in reader."""
    return F.get_json_object(doc, path)


def _each(kind: T.DataType, f: Callable):
    """Apply to the first match of a path; null without one."""

    def make(doc: Column, path: str = "$") -> Column:
        tokens = parse_path(path)

        def read(d):
            found = find(d, tokens)
            return f(found[0][2]) if found else None

        return _udf(kind, read)(doc)

    return make


def _built_in(kind: T.DataType, f: Callable, made: Callable):
    """``made(kind of the value, its text)`` from built-in functions where the path allows."""
    batches = _each(kind, f)

    def make(doc: Column, path: str = "$") -> Column:
        at = definite(path)
        if at is None:
            return batches(doc, path)
        return made(F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), at, "variant")), F.get_json_object(doc, at))

    return make


_KIND = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}


def _type(kind: Column, text: Column) -> Column:
    out = F.when(kind.isNull(), F.lit(None))
    for sign, name in _KIND.items():
        out = out.when(F.startswith(kind, F.lit(sign)), F.lit(name))
    return out.when(F.regexp_like(text, F.lit(r"^-?[0-9]+$")), F.lit("integer")).otherwise(F.lit("number"))


type_of = _built_in(T.StringType(), lambda v: TYPES[type(v)], _type)
str_len = _built_in(T.LongType(), lambda v: len(v) if isinstance(v, str) else None, lambda kind, text: F.when(kind == "STRING", F.length(text)).cast("long"))
arr_len = _built_in(T.LongType(), lambda v: len(v) if isinstance(v, list) else None, lambda kind, text: F.when(F.startswith(kind, F.lit("ARRAY")), F.json_array_length(text)).cast("long"))
obj_len = _built_in(T.LongType(), lambda v: len(v) if isinstance(v, dict) else None, lambda kind, text: F.when(F.startswith(kind, F.lit("OBJECT")), F.size(F.json_object_keys(text))).cast("long"))
obj_keys = _built_in(T.ArrayType(T.StringType()), lambda v: list(v) if isinstance(v, dict) else None, lambda kind, text: F.when(F.startswith(kind, F.lit("OBJECT")), F.json_object_keys(text)))
memory = _each(T.LongType(), lambda v: len(dumps(v).encode()))


def resp(doc: Column, path: str = "$") -> Column:
    """Containers as arrays with a sign for their kind in front, scalars as they are."""

    def form(v):
        if isinstance(v, dict):
            return ["{", *(x for k, w in v.items() for x in (k, form(w)))]
        return ["[", *map(form, v)] if isinstance(v, list) else v

    return _each(T.StringType(), lambda v: dumps(form(v)))(doc, path)


_CHANGED = T.StructType([T.StructField("doc", T.StringType()), T.StructField("reply", T.StringType())])


def _change(doc: Column, path: str, f: Callable) -> Column:
    """struct(doc, reply): ``f(value)`` gives (new value, reply) for each match, of which the
    last reply counts; a match for which it gives None is left alone."""
    tokens = parse_path(path)

    def run(d):
        reply = None
        for parent, at, v in find(d, tokens):
            got = f(v)
            if got is None:
                continue
            if parent is None:
                d = got[0]
            else:
                parent[at] = got[0]
            reply = got[1]
        return {"doc": dumps(d), "reply": None if reply is None else str(reply)}

    @F.pandas_udf(_CHANGED)
    def rows(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for docs in parts:
            yield pd.DataFrame([run(x) if fine else {"doc": d, "reply": None} for d, (x, fine) in zip(docs, map(loads, docs))], columns=["doc", "reply"])

    return rows(doc)


def put(doc: Column, path: str, new: str, only: str | None = None) -> Column:
    """SET: a last key that is missing is made in its parent; ``only``: NX or XX."""
    tokens, x = parse_path(path), json.loads(new)

    def run(d):
        hits = find(d, tokens)
        if hits and only != "NX":
            for parent, at, _ in hits:
                if parent is None:
                    return x
                parent[at] = x
        elif not hits and only != "XX" and tokens and isinstance(tokens[-1], str):
            for _, _, v in find(d, tokens[:-1]):
                if isinstance(v, dict):
                    v[tokens[-1]] = x
        return d

    return F.coalesce(_udf(T.StringType(), lambda d: dumps(run(d)))(doc), doc)


def delete(doc: Column, path: str) -> Column:
    """struct(doc, reply): how many were deleted."""
    tokens = parse_path(path)

    def run(d):
        hits = find(d, tokens)
        for parent, at, _ in sorted((h for h in hits if h[0] is not None), key=lambda h: h[1] if isinstance(h[1], int) else 0, reverse=True):
            del parent[at]
        return None if any(h[0] is None for h in hits) else dumps(d), str(len(hits))

    @F.pandas_udf(_CHANGED)
    def rows(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for docs in parts:
            yield pd.DataFrame([run(x) if fine else (d, None) for d, (x, fine) in zip(docs, map(loads, docs))], columns=["doc", "reply"])

    return rows(doc)


def merge_patch(target, patch):
    """RFC 7396."""
    if not isinstance(patch, dict):
        return patch
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in patch.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = merge_patch(out.get(k), v)
    return out


def merge(doc: Column, path: str, patch: str) -> Column:
    p = json.loads(patch)
    return _change(doc, path, lambda v: (merge_patch(v, p), "OK")).getField("doc")


def _number(v) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def num_incr(doc: Column, path: str, by: float) -> Column:
    return _change(doc, path, lambda v: (float(v) + by,) * 2 if _number(v) else None)


def num_mult(doc: Column, path: str, by: float) -> Column:
    return _change(doc, path, lambda v: (float(v) * by,) * 2 if _number(v) else None)


def toggle(doc: Column, path: str) -> Column:
    return _change(doc, path, lambda v: (not v, str(not v).lower()) if isinstance(v, bool) else None)


def clear(doc: Column, path: str = "$") -> Column:
    return _change(doc, path, lambda v: (type(v)(), 1) if isinstance(v, (dict, list)) else (0, 1) if _number(v) else None)


def str_append(doc: Column, path: str, tail: str) -> Column:
    """The reply is the new length in bytes."""
    return _change(doc, path, lambda v: (v + tail, len((v + tail).encode())) if isinstance(v, str) else None)


def arr_append(doc: Column, path: str, *new: str) -> Column:
    xs = [json.loads(x) for x in new]
    return _change(doc, path, lambda v: (v + xs, len(v) + len(xs)) if isinstance(v, list) else None)


def arr_insert(doc: Column, path: str, index: int, *new: str) -> Column:
    """The index is clamped to the array."""
    xs = [json.loads(x) for x in new]

    def f(v):
        if not isinstance(v, list):
            return None
        at = max(index + len(v), 0) if index < 0 else min(index, len(v))
        return v[:at] + xs + v[at:], len(v) + len(xs)

    return _change(doc, path, f)


def arr_pop(doc: Column, path: str = "$", index: int = -1) -> Column:
    def f(v):
        if not isinstance(v, list) or not v:
            return None
        at = min(max(index + len(v) if index < 0 else index, 0), len(v) - 1)
        return v[:at] + v[at + 1 :], dumps(v[at])

    return _change(doc, path, f)


def arr_trim(doc: Column, path: str, start: int, stop: int) -> Column:
    def f(v):
        if not isinstance(v, list):
            return None
        lo = max(start + len(v), 0) if start < 0 else start
        hi = stop + len(v) if stop < 0 else stop
        return v[lo : hi + 1], len(v[lo : hi + 1])

    return _change(doc, path, f)


def arr_index(doc: Column, path: str, wanted: str, start: int = 0, stop: int = 0) -> Column:
    """First index of a value in [start, stop) (0: to the end), or -1."""
    x = json.loads(wanted)

    def f(v):
        if not isinstance(v, list):
            return None
        lo = max(start + len(v), 0) if start < 0 else start
        hi = len(v) if stop == 0 else stop + len(v) if stop < 0 else min(stop, len(v))
        return next((i for i in range(lo, hi) if v[i] == x and type(v[i]) is type(x)), -1)

    return _each(T.LongType(), f)(doc, path)
