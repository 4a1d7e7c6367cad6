"""Token counts for every prefix of a text.

A sentencepiece BPE vocabulary without a piece that holds a word mark after another
character never merges across the start of a word, so

    count(prefix up to word j) = count(prefix up to word j - 1) + count(word j)

is exact; the program stores these counts at every word's end, and the count of a text is the
last of them. Inside a word the count at each character follows from the same kind of
recurrence: the encoding of a prefix is the encoding of a shorter prefix plus one last
piece, and that holds for a piece exactly if the pair (last piece so far, piece) stays as
it is when both are encoded together. The stored counts answer what a prefix costs
(``at``) and how much of a text fits a budget (``cut``) without encoding anything again;
``prefix_counts`` writes them out as a column, from which ``tokens_before`` answers with
DataFrame functions alone.

Nulls count as the empty text, which has no tokens. Texts of any length are counted whole.
Repeated rows are counted each. A new column whose name is taken gets an underscore.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, table

MARK = "▁"
#: Words kept in a Python worker before its store starts anew.
STORE_WORDS = 600_000
TOKEN_LIMIT = 4096
MODEL = "piece_bpe_32k.model"

_RUNS = re.compile(r" +[^ ]*")


class _WordCounts(dict):
    """Tokens of a word that a single word mark precedes."""

    def __init__(self, encode):
        self.encode = encode
        self[""] = 1  # the mark alone

    def __missing__(self, word: str) -> int:
        if len(self) >= STORE_WORDS:
            self.clear()
            self[""] = 1
        n = self[word] = len(self.encode(word))
        return n


class PrefixCounter:
    """Exact token counts of one sentencepiece BPE model without added tokens."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece crosses the start of a word; words cannot be counted alone")
        self.pieces = {p for i, p in enumerate(pieces) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))}
        self.longest = max(map(len, self.pieces))
        self.words = _WordCounts(self.model.encode)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._inner: dict[str, list[int]] = {}

    def split(self, text: str) -> list[str]:
        """Words as keys of ``words``: without the one space that stands before each."""
        text = text.replace(MARK, " ")
        if "  " in text or text[:1] == " " or text[-1:] == " ":
            return [run[1:] for run in _RUNS.findall(" " + text)]
        return text.split(" ")

    def count(self, text: str | None) -> int:
        return self.at_words(text)[1][-1] if text else 0

    def at_words(self, text: str | None) -> tuple[list[int], list[int]]:
        """(end of each word in characters, tokens up to there): the stored prefix counts."""
        if not text:
            return [], []
        words = self.split(text)
        ends = list(accumulate(map(len, words), lambda end, n: end + n + 1))
        return ends, list(accumulate(map(self.words.__getitem__, words)))

    def inside(self, word: str) -> list[int]:
        """Tokens of ``mark + word[:i]`` for i from 0 to the word's length."""
        if word in self._inner:
            return self._inner[word]
        s = MARK + word.replace(" ", MARK)
        counts, last = [0] * (len(s) + 1), [""] * (len(s) + 1)
        for end in range(1, len(s) + 1):
            c = s[end - 1]
            if c not in self.pieces:  # bytes, which no merge touches
                counts[end], last[end] = counts[end - 1] + len(c.encode()), "\0"
                continue
            for size in range(min(self.longest, end), 0, -1):
                piece, before = s[end - size : end], last[end - size]
                if piece in self.pieces and self._stays(before, piece):
                    counts[end], last[end] = counts[end - size] + 1, piece
                    break
        if len(self._inner) >= STORE_WORDS // 20:
            self._inner.clear()
        self._inner[word] = counts[1:]
        return counts[1:]

    def _stays(self, before: str, piece: str) -> bool:
        if (before, piece) not in self._pairs:
            joined = [piece] if before in ("", "\0") else [before, piece]
            self._pairs[before, piece] = self._alone("".join(joined)) == joined
        return self._pairs[before, piece]

    def _alone(self, s: str) -> list[str]:
        """Pieces of ``s``, which need not start with a word mark: an unknown character
        in front keeps the mark that the model adds away from it."""
        if s == MARK:
            return [MARK]  # the model adds no mark to the empty text
        if s.startswith(MARK):
            return self.model.encode(s[1:], out_type=str)
        out = self.model.encode("\0" + s, out_type=str)
        return out[out.index("<0x00>") + 1 :]

    def at(self, text: str, n_chars: int, stored: tuple[list[int], list[int]] | None = None) -> int:
        """Tokens of ``text[:n_chars]``, from its ``at_words``."""
        if not text or n_chars <= 0:
            return 0
        ends, counts = stored or self.at_words(text)
        if n_chars >= len(text):
            return counts[-1]
        k = bisect_right(ends, n_chars - 1)
        before, start = (counts[k - 1], ends[k - 1] + 1) if k else (0, 0)
        if n_chars < start:
            return before
        return before + self.inside(self.split(text)[k])[n_chars - start]

    def cut(self, text: str, budget: int, stored: tuple[list[int], list[int]] | None = None) -> int:
        """The most characters from the start of ``text`` that ``budget`` tokens hold
        (the count can fall as a prefix grows; the longest fitting prefix is meant), from
        its ``at_words``."""
        if not text:
            return 0
        ends, counts = stored or self.at_words(text)
        if counts[-1] <= budget:
            return len(text)
        words, best = self.split(text), 0
        fits = bisect_right(counts, budget)  # counts only grow from word to word
        start = ends[fits - 1] + 1 if fits else 0
        best = ends[fits - 1] if fits else 0
        base = counts[fits - 1] if fits else 0
        for k in range(fits, len(words)):
            if base + 1 > budget:
                break
            inside = self.inside(words[k])
            for i, n in enumerate(inside):
                if base + n <= budget:
                    best = max(best, start + i)
            base, start = counts[k], ends[k] + 1
        return best


_counters: dict[str, PrefixCounter] = {}


def counter(model_path: str) -> PrefixCounter:
    if model_path not in _counters:
        _counters[model_path] = PrefixCounter(model_path)
    return _counters[model_path]


_ANSWER = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("fits_chars", T.LongType())])
_PREFIXES = T.StructType([T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("tokens", T.ArrayType(T.LongType()))])


def token_counts(df: DataFrame, model_path: str, text: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """``df`` with n_bytes, n_tokens, over_limit, and fits_chars: how many characters of the
    text ``limit`` tokens hold."""

    @F.pandas_udf(_ANSWER)
    def answer(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = counter(model_path)
        for texts in parts:
            rows = []
            for t in texts:
                stored = c.at_words(t)
                n = stored[1][-1] if t else 0
                rows.append((n, len(t or "") if n <= limit else c.cut(t, limit, stored)))
            yield pd.DataFrame(rows, columns=["n_tokens", "fits_chars"])

    got, n_bytes, n_tokens, over, fits = fresh(df, "got", "n_bytes", "n_tokens", "over_limit", "fits_chars")
    body = F.coalesce(F.col(text), F.lit(""))
    return df.withColumn(got, answer(F.col(text))).select(
        *(F.col(f"`{c}`") for c in df.columns),
        F.octet_length(body).cast("long").alias(n_bytes),
        F.col(f"{got}.n_tokens").alias(n_tokens),
        (F.col(f"{got}.n_tokens") > limit).alias(over),
        F.col(f"{got}.fits_chars").alias(fits),
    )


def prefix_counts(df: DataFrame, model_path: str, text: str = "text") -> tuple[DataFrame, str]:
    """``df`` with one column more, and its name: struct of ``ends``, the characters up to
    each word's end, and ``tokens``, the tokens up to there (both empty without text)."""

    @F.pandas_udf(_PREFIXES)
    def stored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        c = counter(model_path)
        for texts in parts:
            yield pd.DataFrame([c.at_words(t) for t in texts], columns=["ends", "tokens"])

    (name,) = fresh(df, "prefixes")
    return df.withColumn(name, stored(F.col(text))), name


def tokens_before(prefixes: Column, n_chars: Column) -> Column:
    """Tokens of the whole words that end within the first ``n_chars`` characters."""
    return F.coalesce(F.get(prefixes.tokens, F.size(F.filter(prefixes.ends, lambda e: e <= n_chars)) - 1), F.lit(0).cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count under piece_bpe_32k.model."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path(MODEL)).select("doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars")
