"""A detector for the language gate: words that one language has nearly to itself, learned from labelled texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words kept of each language; texts of which a language must have a word, and its part of all texts with the word.
MOST_WORDS, LEAST_TEXTS, LEAST_SHARE = 80, 3, 0.8
#: Words of the winner that a text must have, and how many times those of the next language.
LEAST_HITS, AHEAD = 3, 2


def words(text: Column) -> Column:
    """The different words of a text in small letters."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: F.length(w) > 1))


def fit(labelled: DataFrame, label: str, text: str) -> dict[str, list[str]]:
    """The commonest words of each language that it has nearly to itself; counted over all texts, ``MOST_WORDS`` a language come back.

    Rows without a label or text are left out. Labels are as they stand: unify their spelling before.
    """
    one = labelled.filter(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(label).alias("l"), F.explode(words(F.col(text))).alias("w"))
    n = one.groupBy("l", "w").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("w"))
    own = n.withColumn("share", share).filter((F.col("share") >= LEAST_SHARE) & (F.col("n") >= LEAST_TEXTS))
    top = own.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "w"))).filter(F.col("r") <= MOST_WORDS)
    out: dict[str, list[str]] = {}
    for row in top.sort("l", "r").collect():
        out.setdefault(row["l"], []).append(row["w"])
    return out


def detector(known: dict[str, list[str]]) -> Callable[[Column], Column]:
    """A function from a text to its language; null where the words do not tell."""

    def detect(text: Column) -> Column:
        def of(own: Column) -> Column:
            hits = [F.struct(F.size(F.array_intersect(own, F.array(*map(F.lit, ws)))).alias("n"), F.lit(name).alias("l")) for name, ws in sorted(known.items()) if ws]
            ranked = F.sort_array(F.array(*hits, F.struct(F.lit(0).alias("n"), F.lit("").alias("l"))), False)
            first, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
            return F.when((first["n"] >= LEAST_HITS) & (first["n"] >= AHEAD * second["n"]), first["l"])

        # as the variable of a function the words are cut once
        return F.get(F.transform(F.array(F.coalesce(words(text), F.array().cast("array<string>"))), of), F.lit(0))

    return detect
