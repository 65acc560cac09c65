"""Text scalar functions as column expressions: folding, tokens with offsets, analysis."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.stem import remembered, stemmed

#: Words with inner apostrophes, Cyrillic words, numbers. ASCII digits only, in every engine.
TOKEN = r"[a-z]+(?:['`][a-z]+)*|[а-я]+|[0-9]+(?:[.,][0-9]+)*"

# Stopwords that results depend on.
RUSSIAN_STOPWORDS = (
    "и в во не что он на я с со как а то все она так его но да ты к у же вы за бы по только ее мне было вот от меня "
    "еще нет о из ему теперь когда даже ну вдруг ли если уже или ни быть был него до вас нибудь опять уж вам ведь там "
    "потом себя ничего ей может они тут где есть надо ней для мы тебя их чем была сам чтоб без будто чего раз тоже "
    "себе под будет ж тогда кто этот того потому этого какой совсем ним здесь этом один почти мой тем чтобы нее "
    "сейчас были куда зачем всех никогда можно при наконец два об другой хоть после над больше тот через эти нас про "
    "всего них какая много разве три эту моя впрочем хорошо свою этой перед иногда лучше чуть том нельзя такой им "
    "более всегда конечно всю между"
).split()
ENGLISH_STOPWORDS = (
    "a an and are as at be but by for if in into is it its no not of on or such that the their then there these they "
    "this to was will with from your you we our have has had can could should would about which when where who whom "
    "how what"
).split()
STOPWORDS = tuple(sorted({*RUSSIAN_STOPWORDS, *ENGLISH_STOPWORDS}))


def fold(text: Column) -> Column:
    """Lower case and ``е`` for ``ё``. ``İ`` alone would become two characters; it is ``i``, so that places stay."""
    return F.replace(F.lower(F.replace(text, F.lit("İ"), F.lit("i"))), F.lit("ё"), F.lit("е"))


def folded(text: str) -> str:
    """``fold`` in Python."""
    return text.replace("İ", "i").lower().replace("ё", "е")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(text), F.lit(TOKEN), F.lit(0))


_FOUND = re.compile(TOKEN).findall


def tokens_of(text: str) -> list[str]:
    """``tokens`` in Python."""
    return _FOUND(folded(text))


def word_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n, chars, i, begin, stop: the i-th of n tokens at begin..stop in code points; a row with empty extent for none.

    Offsets are running sums of the lengths of tokens and of what stands between them.
    """
    folded = fold(F.col("text"))
    base = docs.withColumns({"__gaps": F.split(folded, TOKEN, -1), "__found": F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0))})
    steps = F.zip_with(F.slice("__gaps", F.lit(1), F.greatest(F.size("__found"), F.lit(1))), F.col("__found"), lambda g, t: F.struct(F.length(g).alias("gap"), F.coalesce(F.length(t), F.lit(0)).alias("size")))
    # sizes first: an exploded row then carries numbers, not the text and the arrays
    sized = base.select("doc_id", F.size("__found").alias("n"), F.length("text").alias("chars"), steps.alias("steps"))
    pieces = sized.select("doc_id", "n", "chars", F.posexplode("steps").alias("i", "x"))
    run = Window.partitionBy("doc_id").orderBy("i")
    pieces = pieces.withColumn("stop", F.sum(F.col("x.gap") + F.col("x.size")).over(run)).withColumn("begin", F.col("stop") - F.col("x.size"))
    return pieces.drop("x")


def analyzed(text: Column, least: int = 2, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Terms in order, with repeats, without stopwords and short tokens; unstemmed."""
    # isin over literals becomes a hash set; array_contains would compare every word with every stopword
    return F.filter(tokens(text), lambda t: (F.length(t) >= least) & (~t.isin(*stopwords) if stopwords else F.lit(True)))


@cache
def _as_set(words: tuple[str, ...]) -> frozenset[str]:
    return frozenset(words)


@dataclass(frozen=True)
class Analyzer:
    """What becomes of a text's tokens: stopwords and short ones go, the rest is stemmed."""

    least: int = 2
    stopwords: tuple[str, ...] = STOPWORDS
    stemming: bool = True

    def surface(self, text: Column) -> Column:
        """The terms as they are written."""
        return analyzed(text, self.least, self.stopwords)

    def terms(self, text: Column) -> Column:
        """The terms that count. Stemming here sends them through Arrow; for whole corpora see ``search.postings``."""
        return stemmed(self.surface(text)) if self.stemming else self.surface(text)

    def counts(self, text: str) -> tuple[dict[str, int], int]:
        """The terms of one text with their occurrences, and the sum of these, in Python."""
        seen, stop = Counter(tokens_of(text)), _as_set(self.stopwords)
        out: dict[str, int] = {}
        for t, n in seen.items():
            if len(t) >= self.least and t not in stop:
                t = remembered(t) if self.stemming else t
                out[t] = out.get(t, 0) + n
        return out, sum(out.values())


#: Terms as they are written.
PLAIN = Analyzer(stemming=False)


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def snippet(text: Column, limit: int) -> Column:
    flat = collapse_whitespace(text)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.rtrim(F.substring(flat, 1, limit - 1)), F.lit("…")))


def embedding_text(heading: Column, text: Column) -> Column:
    body = collapse_whitespace(text)
    return F.when(F.coalesce(heading, F.lit("")) != "", F.concat(heading, F.lit("\n"), body)).otherwise(body)
