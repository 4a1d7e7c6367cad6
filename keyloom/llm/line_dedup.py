"""Removal of lines that stand in three-line windows seen before.

A window is three consecutive lines that are not blank, compared without the white space
around them. Of all places of a window, the first by (doc_id, text's hash, position) stays;
the lines of every later place are removed, where overlapping windows merge. Lines are split at \\n;
blank lines stay. Windows are known by two 64-bit hashes.

Counts and first places are aggregated before they are shuffled, and the places of a
window that a third of all documents hold meet the table of repeated windows in a join that
adaptive execution splits.

Null texts have no lines and stay null; texts of under three lines are never changed. A
document is a doc_id of any type with a text: different texts of one doc_id, or of none (null
comes first), are different documents, and rows that repeat both are one document, judged
alike. Columns other than the text are carried as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, identity, table

WINDOW = 3


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(text: Column) -> Column:
    """array<struct<a, b, at>> : hashes of a window, and the positions of its lines."""
    solid = let(lines_of(text), lambda ls: F.filter(F.transform(ls, lambda x, i: F.struct(F.btrim(x, F.lit(" \t\r\u000b\f")).alias("x"), i.alias("i"))), lambda s: s.x != ""))

    def over(s: Column) -> Column:
        def window(k: Column) -> Column:
            three = [F.get(s, k + j) for j in range(WINDOW)]
            return F.struct(
                F.xxhash64(*(t.x for t in three)).alias("a"),
                F.xxhash64(F.lit(WINDOW), *(t.x for t in reversed(three))).alias("b"),
                F.array(*(t.i for t in three)).alias("at"),
            )

        empty = F.filter(F.transform(F.array(F.lit(0)), window), lambda _: F.lit(False))
        return F.when(F.size(s) >= WINDOW, F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - WINDOW, F.lit(0))), window)).otherwise(empty)

    return let(solid, over)


def removed_lines(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(k, ta, tb, gone): the positions of the lines to remove, for documents that have any;
    a document is its key and the identity of its text."""
    ta, tb = identity(F.col(text))
    places = df.select(F.col(key).alias("k"), ta.alias("ta"), tb.alias("tb"), F.inline(_windows(F.col(text)))).select("a", "b", "at", F.struct("k", "ta", "tb", F.get("at", F.lit(0)).alias("p")).alias("place"))
    seen = places.groupBy("a", "b").agg(F.min("place").alias("first"), F.max("place").alias("last")).where(F.col("first") < F.col("last")).select("a", "b", "first")
    later = places.join(seen, ["a", "b"]).where(F.col("first") < F.col("place"))
    return later.select("place.k", "place.ta", "place.tb", F.explode("at").alias("p")).groupBy("k", "ta", "tb").agg(F.collect_set("p").alias("gone"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", counts: bool = False) -> DataFrame:
    """``df`` with the lines removed from its text; with ``counts`` also n_lines and
    n_removed (longs)."""
    ta, tb, gone, *other, n_lines, n_removed = fresh(df, "ta", "tb", "gone", "k_", "ta_", "tb_", "n_lines", "n_removed")
    found = removed_lines(df, key, text).toDF(*other, gone)
    body = df.withColumns(dict(zip((ta, tb), identity(F.col(text)))))
    both = body.join(found, F.col(key).eqNullSafe(F.col(other[0])) & (F.col(ta) == F.col(other[1])) & (F.col(tb) == F.col(other[2])), "left")
    lines = lines_of(F.col(text))
    stay = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone))
    left = let(lines, lambda ls: F.array_join(F.transform(stay(ls), lambda i: F.get(ls, i)), "\n"))
    kept = F.when(F.col(gone).isNull(), F.col(text)).otherwise(left)
    out = [kept.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns]
    if counts:
        out.append(F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias(n_lines))
        out.append(F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias(n_removed))
    return both.select(*out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, those removed, and the md5 of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=True).select("doc_id", "n_lines", "n_removed", F.octet_length("text").cast("long").alias("n_bytes"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


SQL = r"""
WITH ls AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
solid AS (
  SELECT doc_id, pos, trim(line, E' \t\r\x0b\x0c') AS x FROM ls WHERE trim(line, E' \t\r\x0b\x0c') <> ''),
win AS (
  SELECT doc_id, pos AS p0, lead(pos) OVER w AS p1, lead(pos, 2) OVER w AS p2, x, lead(x) OVER w AS x1, lead(x, 2) OVER w AS x2
  FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x, x1, x2 ORDER BY doc_id, p0) AS n FROM win WHERE x2 IS NOT NULL) WHERE n > 1),
gone AS (
  SELECT doc_id, p0 AS pos FROM later UNION SELECT doc_id, p1 FROM later UNION SELECT doc_id, p2 FROM later),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS t
  FROM ls l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, strlen(coalesce(t, '')) AS n_bytes, md5(coalesce(t, '')) AS kept_md5 FROM kept
"""
