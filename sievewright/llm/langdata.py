"""Sentences in known languages, to fit models on.

They come from a bounded sample of labelled texts. Some labels are wrong, so a naive Bayes vote of the sample's own words
checks every sentence, and only sentences that the vote gives to their label stay.
"""

from __future__ import annotations

import locale
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Labelled texts that a model may be fitted on, and characters of them per language; raising them changes quality, not results' completeness.
SAMPLE_TEXTS = 4_000
SAMPLE_CHARS = 240_000

# Eight languages with their usual names: ISO 639-1, 639-2 and English and own names.
NAMES = {
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "fr": "fr fra fre french français francais",
    "es": "es spa spanish español espanol castellano castilian",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish vlaams",
    "pl": "pl pol polish polski",
    "ru": "ru rus russian русский",
}
# names under which the platform's locales know no language
_NO_LANGUAGE = {"univ", "universal", "cextend"}


def _codes() -> dict[str, str]:
    """Name -> code: the names above, and for all other languages the codes and English names of the platform's locale aliases."""
    out: dict[str, str] = {}
    for alias, target in locale.locale_alias.items():
        code = target.split("_")[0].split(".")[0].lower()
        if len(code) == 2 and code.isalpha():
            out.setdefault(code, code)
            if alias.isalpha() and len(alias) > 3 and alias not in _NO_LANGUAGE:
                out[alias] = code
    return out | {name: code for code, names in NAMES.items() for name in names.split()}


CODE_OF = _codes()
#: Labelled texts below which a language gets no model: a lone one may be a slip.
LEAST_TEXTS = 2

WORD = re.compile(r"[^\W\d_]+")
_SPLIT = re.compile(r"(?<=[.!?…:;])\s+(?=\S)|\n+")


def sentences(text: str) -> list[str]:
    """Pieces of a text that end like sentences or lines."""
    return [s for s in _SPLIT.split(text) if s]


def label_code(label: str | None) -> str | None:
    """The two-letter code that a label in any usual spelling names, with or without a country; None if it names none of the known."""
    if not label:
        return None
    s = label.strip().lower()
    return CODE_OF.get(s) or CODE_OF.get(re.split(r"[-_@. ]", s)[0])


def label_column(label: Column) -> Column:
    """:func:`label_code` as a Column."""
    name = F.lower(F.regexp_replace(label, r"(?U)^\s+|\s+$", ""))
    known = F.create_map(*[F.lit(x) for pair in CODE_OF.items() for x in pair])
    return F.coalesce(known[name], known[F.split(name, "[-_@. ]")[0]])


def _quotas(counts: dict[str, int], most: int) -> dict[str, int]:
    """How many of ``most`` texts each language gets: equal parts; what a language can't fill goes to the others."""
    out: dict[str, int] = {}
    for k, c in enumerate(sorted(counts, key=lambda c: (counts[c], c))):
        out[c] = min(counts[c], (most - sum(out.values())) // (len(counts) - k))
    return out


def labelled_texts(documents: DataFrame, language: str, text: str, most_texts: int) -> dict[str, list[str]]:
    """At most ``most_texts`` texts by the language of their label, drawn by a share of row hashes per language.

    They are spread over the table however it is ordered, and the same in every run; all texts if there are no more.
    """
    row = F.xxhash64(*[F.col(f"`{c}`") for c, kind in documents.dtypes if "map<" not in kind and "variant" not in kind])
    known = documents.select(label_column(F.col(language)).alias("code"), F.col(text).alias("text"), row.alias("h")).filter("code IS NOT NULL AND text IS NOT NULL AND text <> ''")
    counts = {r["code"]: r["count"] for r in known.groupBy("code").count().collect() if r["count"] >= LEAST_TEXTS}
    quotas = _quotas(counts, most_texts)
    if not quotas:
        return {}
    # somewhat more than the quota by share, so that few rows are ranked; then the quota exactly, as repeated rows share their hash
    share = {c: min(1.0, (q + 6 * math.sqrt(q)) / counts[c]) for c, q in quotas.items()}
    of = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("code")]
    drawn = known.filter(F.pmod("h", F.lit(1 << 40)) < of({c: math.ceil(x * (1 << 40)) for c, x in share.items()}))
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("code").orderBy(F.pmod("h", F.lit(1 << 40)), "text"))).filter(F.col("rank") <= most_texts)
    by: dict[str, list[str]] = {}
    for r in sorted(ranked.filter(F.col("rank") <= of(quotas)).select("code", "rank", "text").collect(), key=lambda r: (r["code"], r["rank"])):
        by.setdefault(r["code"], []).append(r["text"])
    return by


def labelled_sentences(documents: DataFrame, language: str = "lang", text: str = "text", most_texts: int = SAMPLE_TEXTS, most_chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Clean sentences per language from at most ``most_texts`` labelled texts, about ``most_chars`` characters per language."""
    by = {c: [sentences(t) for t in texts] for c, texts in labelled_texts(documents, language, text, most_texts).items()}
    counts = {c: Counter(w for d in docs for s in d for w in set(WORD.findall(s.lower()))) for c, docs in by.items()}
    total = {c: sum(n.values()) or 1 for c, n in counts.items()}
    score: dict[str, dict[str, float]] = {}
    for w in {w for n in counts.values() for w in n}:
        score[w] = {c: math.log((counts[c][w] + 0.05) / total[c]) for c in counts}

    def vote(s: str) -> str | None:
        sums = dict.fromkeys(counts, 0.0)
        for w in WORD.findall(s.lower()):
            for c, v in score.get(w, {}).items():
                sums[c] += v
        best = sorted(sums.items(), key=lambda x: -x[1])[:2]
        return best[0][0] if len(best) == 1 or best[0][1] - best[1][1] > 3 else None

    out: dict[str, list[str]] = {}
    for c in sorted(by):
        kept: list[str] = []
        size = 0
        # every n-th sentence of every text, so that the sample is spread over texts
        every = [s for d in by[c] for s in d]
        step = max(1, sum(map(len, every)) // most_chars)
        for i in range(step):
            for s in every[i::step]:
                if size < most_chars and len(s) > 15 and vote(s) == c:
                    kept.append(s)
                    size += len(s)
        out[c] = kept
    return out
