"""Quality rules: per-text counts and the frequency of lines across documents.

Lines are compared in lower case with white space collapsed, by a 64-bit hash. A host (the
``source``; null is a host of its own) holds a line in as many documents as have different
texts, so copies of one text count once. A line is above the limit when more than
``LINE_SHARE`` of the host's distinct texts hold it, and ``LINE_DOCS`` of them at least. Such
lines are removed, and a document is depleted, hence rejected, when less than ``LEFT_SHARE``
of its words remain.

Null texts have no words and fail the base rules. Rows that share a doc_id, or have none, are
judged each by its own text, and rows that repeat both alike. Ids may be of any type. Other
columns are not carried. An empty table gives no rows. A third of all rows in one host is no hot
spot: lines are counted per host and line, and before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, scratch, table
from .line_dedup import let, lines_of

LINE_SHARE, LINE_DOCS, LEFT_SHARE = 0.02, 10, 0.3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Frequent lines are broadcast up to this number of rows, and joined by shuffle beyond.
BROADCAST_LINES = 200_000

_SPACE = " \t\n\u000b\f\r"
_GAP = r"[\x20\x09-\x0D]+"


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(_SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _GAP))


def _repeated(words: Column) -> Column:
    """How many words lie in three-word windows that the text holds twice or more."""
    hashes = F.when(
        F.size(words) >= 4,
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))),
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(hs: Column) -> Column:
        ordered = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def marked(s: Column) -> Column:
            same = F.filter(s, lambda x, j: (x.h == F.get(s, j - 1).h) | (x.h == F.get(s, j + 1).h))
            return F.size(F.array_distinct(F.flatten(F.transform(same, lambda x: F.array(x.i, x.i + 1, x.i + 2)))))

        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(ordered, marked))

    return let(hashes, covered)


def base_counts(text: Column) -> Column:
    """struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    body = F.coalesce(text, F.lit(""))
    solid = F.filter(lines_of(body), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    lines = let(solid, lambda ls: F.size(ls) - F.size(F.array_distinct(ls)))
    return let(
        words_of(body),
        lambda ws: F.struct(
            F.size(ws).cast("long").alias("n_words"),
            F.length(F.array_join(ws, "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            lines.cast("long").alias("n_dup_lines"),
            _repeated(ws).cast("long").alias("n_repeat_words"),
        ),
    )


def _lines(df: DataFrame, host: str, key: str, text: str) -> DataFrame:
    """(host, k, t, p, line, words): the lines of each document, by hash, with their words."""
    def said(x: Column, p: Column) -> Column:
        plain = F.lower(F.regexp_replace(F.btrim(x, F.lit(_SPACE)), _GAP, " "))
        return F.struct(p.alias("p"), F.xxhash64(plain).alias("line"), (F.length(plain) - F.length(F.replace(plain, F.lit(" "))) + 1).cast("long").alias("words"))

    solid = F.filter(lines_of(F.col(text)), lambda x: F.btrim(x, F.lit(_SPACE)) != "")
    return df.select(F.col(host).alias("host"), F.col(key).alias("k"), F.xxhash64(text).alias("t"), F.inline(F.transform(solid, said)))


def _frequent(found: DataFrame, df: DataFrame, host: str, text: str) -> DataFrame:
    """(of, at): hosts and their lines above the limit, of the ``_lines`` of ``df``."""
    per_line = found.select("host", "line", "t").distinct().groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LINE_DOCS)
    texts = df.select(F.col(host).alias("of"), F.xxhash64(text).alias("t")).distinct().groupBy("of").agg(F.count(F.lit(1)).alias("texts"))
    both = per_line.join(texts, F.col("host").eqNullSafe(F.col("of")))
    return both.where(F.col("n") > LINE_SHARE * F.col("texts")).select("of", F.col("line").alias("at"))


def quality(df: DataFrame, host: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``df``: the key, the counts, base_failed, kept and words_left."""
    with scratch(df.sparkSession) as keep:
        found = materialize(_lines(df, host, key, text), "lines")
        frequent = materialize(_frequent(found, df, host, text), "frequent")
        keep += [found, frequent]
    side = F.broadcast(frequent) if frequent.count() <= BROADCAST_LINES else frequent
    hit = found.join(side, F.col("host").eqNullSafe(F.col("of")) & (F.col("line") == F.col("at")))
    once = hit.groupBy("host", "k", "t", "p").agg(F.max("words").alias("words"))  # rows may be repeated
    lost = once.groupBy("host", "k", "t").agg(F.sum("words").alias("lost"))
    own = df.select(F.col(host).alias("own_host"), F.col(key).alias("own_key"), F.xxhash64(text).alias("own_text"), base_counts(F.col(text)).alias("c"))
    both = own.join(lost, F.col("own_key").eqNullSafe(F.col("k")) & (F.col("own_text") == F.col("t")) & F.col("own_host").eqNullSafe(F.col("host")), "left")
    both = both.select("own_key", "lost", "c.*")
    left = F.col("n_words") - F.least(F.coalesce("lost", F.lit(0)), F.col("n_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return both.select(
        F.col("own_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (left >= LEFT_SHARE * F.col("n_words"))).alias("kept"),
        left.alias("words_left"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict for every document."""
    return quality(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
tri AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(3) r(j) GROUP BY doc_id),
raw AS (SELECT doc_id, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
solid AS (SELECT doc_id, source, t, line, lower(regexp_replace(trim(line, E' \t\n\x0b\x0c\r'), '[\x20\x09-\x0D]+', ' ', 'g')) AS plain FROM raw WHERE trim(line, E' \t\n\x0b\x0c\r') <> ''),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM solid GROUP BY doc_id),
host AS (SELECT source, count(DISTINCT t) AS texts FROM d GROUP BY source),
often AS (SELECT source, plain FROM (SELECT source, plain, count(DISTINCT t) AS n FROM solid GROUP BY ALL) JOIN host USING (source) WHERE n >= 10 AND n > 0.02 * texts),
lost AS (SELECT doc_id, sum(len(string_split(plain, ' '))) AS n FROM solid JOIN often USING (source, plain) GROUP BY doc_id),
counted AS (
  SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost.n, 0) AS lost
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words - least(lost, n_words) >= 0.3 * n_words AS kept,
  CAST(n_words - least(lost, n_words) AS BIGINT) AS words_left
FROM counted
"""
