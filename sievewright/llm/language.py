"""Languages of texts and of their passages, by cross-parsing.

The running text of labelled sentences of each language forms a suffix automaton. A sentence is parsed greedily into the
longest phrases, across words, that the automaton knows: the worse the language, the more phrases. A sentence is given
to the language that needs the fewest phrases for its length, and the distance to the next language is its
confidence.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm import garble, uniform
from sievewright.llm.arrowtext import code_points, slices, strings
from sievewright.llm.langdata import WORD, labelled_sentences
from sievewright.session import spread

#: A sentence has this many words at least, and the winner needs so many bits, and so large a part of them, less than the next language.
LEAST_WORDS, LEAST_BITS, LEAST_LEAD = 2, 6, 0.02
#: Words that a worker remembers.
REMEMBERED = 400_000
_BITS = 28
_STATE = (1 << _BITS) - 1
_PER_BIT = 16
_FIELD = 48
_PRICE = (1 << _FIELD) - 1

_QUOTE = re.compile(r"^[\s>|»]*[>|»]\s?")
_HEADER = re.compile(r"^\s*\*?[^\W\d_][\w .’'-]{0,24}:\*?(\s|$)")
# what ends with the dot of an abbreviation, a company's form or "Tel." ends no sentence by it
_END = re.compile(r"(?<!\b[Tt]el)(?<!\bSp)(?<!\s[^\W\d_](?=\.))(?<![^\W\d_]\.[^\W\d_])(?<![^\W\d_]\.[^\W\d_][^\W\d_])[.!?…][\"'“”»)\]]*$")
_ODD = re.compile(r"[^\x00-\x7f]")
_DIGIT, _NUMBER = re.compile(r"\d"), re.compile(r"[^\s\d]*\d\S*")
_DISGUISED = re.compile("[\u0300-\u036f\xad\u200b-\u200f\u2000-\u200a\u202f\u2060-\u2064\u3000\ufeff\uff01-\uff5e\U0001d400-\U0001d7ff]")
# where a passage may be cut, and what must stand up to the mark there
_STOP = re.compile(r"[.!?…][\"'“”»)\]]*\s+")
_CUT = re.compile(r"(?:(?<!\bTel\.)(?<!\bSp\.)(?<![^\W\d_]\.[^\W\d_][^\W\d_]\.)(?<=[^\W\d_]{2}[.!?…])|(?<=[\d€$)%][.!?…])|(?<=[.!?…][.!?…]))\Z")


class SuffixAutomaton:
    """All substrings of a text, built online; ``edges[state][code point]`` is the next state."""

    def __init__(self, text: str) -> None:
        edges: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        last = 0
        for c in map(ord, text):
            cur = len(link)
            link.append(0)
            length.append(length[last] + 1)
            edges.append({})
            p = last
            while p >= 0 and c not in edges[p]:
                edges[p][c] = cur
                p = link[p]
            if p >= 0:
                q = edges[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    # the state splits: the shorter substrings get one of their own
                    own = len(link)
                    link.append(link[q])
                    length.append(length[p] + 1)
                    edges.append(dict(edges[q]))
                    while p >= 0 and edges[p].get(c) == q:
                        edges[p][c] = own
                        p = link[p]
                    link[q] = link[cur] = own
            last = cur
        self.edges = edges
        # a state's substrings end wherever those of the states that link to it end; own places count once
        self.times = [0] * len(link)
        state = 0
        for c in map(ord, text):
            state = edges[state][c]
            self.times[state] += 1
        for p in sorted(range(1, len(link)), key=length.__getitem__, reverse=True):
            self.times[link[p]] += self.times[p]
        self.times[0] = len(text)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first edge of each state, code points of the edges, ascending within a state, their next states, price of a phrase that ends in each state).

        The price is the information in the choice of the phrase among all places of the text, in sixteenths of a bit.
        """
        size = np.fromiter(map(len, self.edges), np.int32, len(self.edges))
        flat = np.array([x for e in self.edges for x in sorted(e.items())], np.int32).reshape(-1, 2)
        price = np.round(_PER_BIT * np.log2((len(self.times) + 1) / np.maximum(self.times, 1))).astype(np.int32)
        return np.concatenate(([0], np.cumsum(size))).astype(np.int32), flat[:, 0].copy(), flat[:, 1].copy(), price


@dataclass
class Model:
    """Automata of the languages as arrays of edges."""

    languages: list[str]
    edges: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    repair: garble.Model | None = None
    hands: tuple[Identifier, garble.Mender | None] | None = field(default=None, repr=False, compare=False)

    def at_hand(self) -> tuple[Identifier, garble.Mender | None]:
        """What applies the model in a Python worker; tasks that follow one another there share what it remembers."""
        if self.hands is None:
            self.hands = Identifier(self), garble.Mender(self.repair) if self.repair else None
        return self.hands


def words_of(sentence: str) -> list[str]:
    """The words of a sentence in small letters, without numbers, dates and codes."""
    return WORD.findall((_NUMBER.sub(" ", sentence) if _DIGIT.search(sentence) else sentence).lower())


def running(sentence: str) -> str:
    """What is parsed of a sentence: its words, one blank around each."""
    return " ".join(["", *words_of(sentence), ""])


def fit(sentences: dict[str, list[str]]) -> Model:
    """Automata of the running text of each language; a sentence that repeats says nothing new and is taken once."""
    texts = {x: "\n".join(dict.fromkeys(map(running, own))) for x, own in sorted(sentences.items())}
    return Model(list(texts), [SuffixAutomaton(t).arrays() for t in texts.values()])


def passages(text: str) -> list[str]:
    """Paragraphs without quote marks, on one line each; lines that look like headers stand alone, and a line that ends with a colon ends one."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        s = _QUOTE.sub("", line).strip()
        if not s:
            out.append([])
        elif _HEADER.match(s) and not _END.search(s):
            out += [[s], []]
        else:
            out[-1].append(s)
            if s[-1] == ":":
                out.append([])
    return [" ".join(p) for p in out if p]


def _cut(passage: str) -> list[str]:
    """A passage in pieces that end with a mark; the last may not."""
    out, last = [], 0
    for m in _STOP.finditer(passage):
        i = m.start() + 1
        if _CUT.search(passage[max(0, i - 6) : i]):
            if i > last:
                out.append(passage[last:i])
            last = m.end()
    if last < len(passage):
        out.append(passage[last:])
    return out


def whole_sentences(text: str) -> list[str]:
    """Sentences that end as such; names, addresses and lines of contacts don't."""
    out = []
    for p in passages(text):
        cut = _cut(p)
        # the mark at the end of all but the last was seen when cutting
        if cut and not _END.search(cut[-1][-60:]):
            cut.pop()
        out += cut
    return out


class Identifier:
    """Parses sentences under all languages; one per Python worker.

    The parse is a walk through the automaton that starts anew at its root wherever no known text goes on. What a word does to
    the walk depends on nothing but the states before it, so that each pair of states and word is walked once and remembered.
    """

    def __init__(self, model: Model) -> None:
        self.languages = model.languages
        self.edges = [tuple(array("i", a.astype(np.int32).tobytes()) for a in e) for e in model.edges]
        self.known: dict[str, tuple[str | None, float]] = {}
        self._forget()

    def _forget(self) -> None:
        """Start with empty memories: words, places (the states of all languages at once) and what a word does at a place."""
        self.words: dict[str, int] = {}
        self.memory: list[dict[int, int]] = [{} for _ in self.languages]
        self.steps: dict[int, tuple[int, int]] = {}
        self.place_of: dict[tuple[int, ...], int] = {}
        self.places: list[tuple[int, ...]] = []
        self.rest: dict[int, int] = {}
        self._place(tuple(self._walk(k, 0, " ") & _STATE for k in range(len(self.languages))))

    def _place(self, states: tuple[int, ...]) -> int:
        i = self.place_of.setdefault(states, len(self.places))
        if i == len(self.places):
            self.places.append(states)
        return i

    def _rest(self, place: int) -> int:
        """The prices of the phrases that are open at a place, side by side."""
        got = self.rest.get(place)
        if got is None:
            got = self.rest[place] = sum(self.edges[k][3][q] << _FIELD * k for k, q in enumerate(self.places[place]))
        return got

    def _step(self, place: int, number: int, word: str) -> tuple[int, int]:
        """(prices under all languages, side by side in one number, next place) of a word at a place."""
        paid, states = 0, []
        for k, state in enumerate(self.places[place]):
            v = self.memory[k].get(number << _BITS | state)
            if v is None:
                v = self.memory[k][number << _BITS | state] = self._walk(k, state, word + " ")
            paid += v >> _BITS << _FIELD * k
            states.append(v & _STATE)
        got = self.steps[number << _BITS | place] = (paid, self._place(tuple(states)))
        return got

    def _walk(self, k: int, state: int, text: str) -> int:
        """The price of the phrases that end within ``text``, and the state after it, in one number."""
        first, codes, to, price = self.edges[k]
        paid = 0
        for c in map(ord, text):
            while True:
                a, z = first[state], first[state + 1]
                i = bisect_left(codes, c, a, z)
                if i < z and codes[i] == c:
                    state = to[i]
                    break
                if not state:  # a character that the language does not have is a phrase by itself, the dearest of all
                    paid += _PER_BIT * len(price).bit_length()
                    break
                paid += price[state]
                state = 0
        return paid << _BITS | state

    def prices(self, words: list[str]) -> list[float]:
        """Bits of the longest known phrases into which the words of a sentence fall, under each language."""
        if len(self.words) > REMEMBERED or len(self.steps) > 4 * REMEMBERED:
            self._forget()
        place, total = 0, 0
        get, known = self.steps.get, self.words
        for w in words:
            i = known.setdefault(w, len(known))
            paid, place = get(i << _BITS | place) or self._step(place, i, w)
            total += paid
        total += self._rest(place)
        return [(total >> _FIELD * k & _PRICE) / _PER_BIT for k in range(len(self.languages))]

    def verdict(self, sentence: str) -> tuple[str | None, float]:
        """(language, confidence from 0 to 1) of a sentence; None if it is too short or no language leads.

        Phrases are normalised to bits a character: a phrase that a language has often says less than a rare one, and any
        says more in a longer text. The confidence is how much the next language needs beyond the winner.
        """
        got = self.known.get(sentence)
        if got is None:
            if len(self.known) > REMEMBERED // 8:
                self.known.clear()
            got = self.known[sentence] = self._verdict(sentence)
        return got

    def _verdict(self, sentence: str) -> tuple[str | None, float]:
        words = words_of(sentence)
        if len(words) < LEAST_WORDS or not self.languages:
            return None, 0.0
        bits = self.prices(words)
        order = sorted(range(len(bits)), key=bits.__getitem__)
        best, then = bits[order[0]], bits[order[min(1, len(bits) - 1)]]
        lead = 1 - best / max(then, 1e-9)
        sure = len(bits) == 1 or then - best >= LEAST_BITS and lead >= LEAST_LEAD
        return (self.languages[order[0]] if sure else None), (1.0 if len(bits) == 1 else lead)

    def verdicts(self, sentences: list[str]) -> list[tuple[str | None, float]]:
        return [self.verdict(s) for s in sentences]


SCHEMA = "lang string, confidence double, segments array<struct<segment_no:int,lang:string,confidence:double,n_sentences:int,n_chars:int>>"


def identify(df: DataFrame, model: Model, key: str, body: str, subject: str | None = None) -> DataFrame:
    """(key, lang, confidence, segments) of each text.

    ``segments`` are runs of whole sentences in one language, in the order of the text; ``lang`` is the
    language of most of their characters, the subject counting where the body has no whole sentence. Garbled text is
    read as it was meant and disguised letters as what they look like. Null, blank and wordless texts have a null
    language, confidence 0 and no segments. A map over Arrow batches with a model of bounded size.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[key].dataType.simpleString()
    columns = df.select(F.col(key).alias("key"), F.col(body).alias("body"), (F.col(subject) if subject else F.lit(None).cast("string")).alias("subject"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        who, mender = shared.value.at_hand()
        segment = pa.struct([("segment_no", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("n_sentences", pa.int32()), ("n_chars", pa.int32())])
        for whole in batches:
            lengths = np.array([len(t or "") for t in whole.column(1).to_pylist()], np.int64)
            for i, j in slices(lengths):
                b = whole.slice(i, j - i)
                texts = _undisguised(b.column(1))
                subjects = b.column(2).to_pylist()
                per = [[_meant(s, mender) for s in whole_sentences(t)] if t else [] for t in texts]
                verdicts = iter(who.verdicts([s for p in per for s in p]))
                langs, sure, segs = [], [], []
                for t, p, sub in zip(texts, per, subjects):
                    own = [(s, *next(verdicts)) for s in p]
                    runs: list[dict] = []
                    for s, lang, x in own:
                        if lang is None:
                            continue
                        if runs and runs[-1]["lang"] == lang:
                            r = runs[-1]
                            r["confidence"] = (r["confidence"] * r["n_chars"] + x * len(s)) / (r["n_chars"] + len(s))
                            r["n_sentences"] += 1
                            r["n_chars"] += len(s)
                        else:
                            runs.append({"segment_no": len(runs), "lang": lang, "confidence": x, "n_sentences": 1, "n_chars": len(s)})
                    main, x = None, 0.0
                    if runs:
                        n = Counter()
                        for r in runs:
                            n[r["lang"]] += r["n_chars"]
                        main = n.most_common(1)[0][0]
                        x = sum(r["confidence"] * r["n_chars"] for r in runs if r["lang"] == main) / sum(r["n_chars"] for r in runs)
                    elif t and t.strip():
                        main, x = who.verdicts([f"{sub or ''} {t}"])[0]
                        x = x if main else 0.0
                    langs.append(main)
                    sure.append(x)
                    segs.append(runs)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(sure, pa.float64()), pa.array(segs, pa.list_(segment))], names=["key", "lang", "confidence", "segments"])

    return spread(columns).mapInArrow(apply, f"key {kind}, {SCHEMA}").withColumnRenamed("key", key)


def _undisguised(column: pa.Array) -> list[str | None]:
    """The texts, those with disguised characters in consistent form."""
    texts = column.to_pylist()
    at = [i for i, t in enumerate(texts) if t is not None and not t.isascii() and _DISGUISED.search(t)]
    if at:
        points, starts, _ = uniform.consistent(*code_points(pa.array([texts[i] for i in at], pa.string())))
        for i, t in zip(at, strings(points, starts).to_pylist()):
            texts[i] = t
    return texts


def _meant(sentence: str, mender: garble.Mender | None) -> str:
    """A sentence with garbling undone where so many characters are beyond ASCII that it may hide the language."""
    if mender is None or sentence.isascii() or 3 * len(_ODD.findall(sentence)) < len(sentence):
        return sentence
    return mender.mend_passage(sentence)[0]


def fit_on(documents: DataFrame) -> Model:
    """A model from labelled texts (``lang``, ``text``), with what it takes to read garbled text."""
    sentences = labelled_sentences(documents)
    model = fit(sentences)
    model.repair = garble.fit(sentences)
    return model
