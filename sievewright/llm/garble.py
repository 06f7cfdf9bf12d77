"""Text that was decoded with the wrong character encoding.

Candidates are chains of steps "encode as the wrong code page, decode as the right one". The description length of a passage
is its size under the best of the zstandard dictionaries, one per language, trained on clean sentences, plus an escape for
every character that the language does not use. The chain is taken after which the passage, together with the cost of the chain, is
described in fewest bytes; otherwise the passage stays. All chains of up to three steps are candidates. Characters that are
gone count as a step of their own: a passage without them, and a byte for each, against the passage as it stands.

Passages are paragraphs. Only tokens that some chain turns into orderly letters give a chain a try, which saves describing
the clean rest; tokens recur, so each worker remembers what the chains make of them.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sievewright.llm.langdata import labelled_sentences
from sievewright.llm.uniform import CYRILLIC_AS_LATIN, GREEK_AS_LATIN
from sievewright.session import spread

#: Bytes of one language's dictionary.
DICTIONARY_BYTES = 64 << 10
#: Bytes that a character outside a language's letters costs on top.
ESCAPE = 2
#: Steps of a chain at most.
LONGEST = 3
#: Tokens that a worker remembers.
REMEMBERED = 300_000

# Fixed values: (right encoding, wrong ones it is taken for, cost of the step in bytes).
STEPS = (
    ("utf-8", "cp1252 latin-1 cp437 cp850 mac_roman cp1250 cp1251 iso8859_2 koi8_r cp866 iso8859_15 cp1254 mac_cyrillic", 1),
    ("cp1252", "cp850 cp437 mac_roman", 2),
    ("cp1251", "cp1252 latin-1 koi8_r cp866 mac_cyrillic", 2),
    ("koi8_r", "cp1251 cp1252 latin-1 cp866", 2),
    ("iso8859_2", "cp1252 latin-1", 2),
    ("cp1250", "cp1252 latin-1", 2),
    ("cp1252", "cp1251 cp1250 iso8859_2 koi8_r cp866", 4),
    ("cp850", "cp1252 latin-1", 4),
    ("cp437", "cp1252 latin-1", 4),
    ("mac_roman", "cp1252 latin-1", 4),
    ("cp866", "cp1251 cp1252 latin-1", 4),
    ("iso8859_5", "cp1252 latin-1 cp1251", 4),
)
# Signs that clean text may hold beside letters.
SIGNS = set("€£¥§°№·•…–—‘’‚“”„«»‹›¡¿½¼¾²³¹µ×±©®™º ­  ⁠​‌‍﻿‑−→←✓☐■□▪▸")
# Letters beyond ASCII of the eight languages; those that names in the sample carry are learned on top.
ALPHABETS = {"de": "äöüß", "en": "", "fr": "àâæçéèêëîïôœùûüÿ", "es": "áéíñóúü", "it": "àèéìíîòóùú", "nl": "áéèëïóöü", "pl": "ąćęłńóśźż", "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"}
# Signs that a lone garbled letter may have been.
LONE_SIGNS = "–—’‘“”„€…"
# the look behind keeps a long run of ASCII letters from being tried from each of them
TOKEN = re.compile(r"(?:(?<![A-Za-z'])[A-Za-z']++)?[^\x00-\x7f][A-Za-z'\x80-\U0010ffff]*")
_TOKENS = re.compile(f"({TOKEN.pattern})")
#: Beyond doubt: the replacement character, and C1 controls, which no encoding in use has for text.
CERTAIN = re.compile("[�\x80-\x84\x86-\x9f]")
_LOST_HYPHEN, _LOST_SPACE = re.compile("Ã(?=[a-z])"), re.compile("[ÃÂ]$")
_SIGNS, _JOINING = "".join(SIGNS), "’‘·­⁠​‌‍﻿‑"
_ODD, _CAPITAL = re.compile(r"[^\x00-\x7f]"), re.compile(r"(?<=[a-zà-ÿ])[À-Þ]")
# disguise is no garble: letters that look Latin within Latin words, and spaces and invisible characters of other kinds
_BLANKS = {chr(c) for c in (0xA0, 0xAD, *range(0x2000, 0x2010), 0x202F, *range(0x2060, 0x2065), 0x3000, 0xFEFF)}
_DISGUISE = {x[0] for x in f"{CYRILLIC_AS_LATIN} {GREEK_AS_LATIN}".split()} | _BLANKS
_PARAGRAPH = re.compile(r"(\n[ \t\r]*\n)")


def _codec(name: str) -> tuple[dict[str, int], str]:
    """(byte of each character, character of each byte); bytes that a code page leaves open are C1 controls."""
    table = "".join(bytes([i]).decode(name, "ignore") or chr(i) for i in range(256))
    return {ch: i for i, ch in enumerate(table)}, table


@dataclass(frozen=True)
class Step:
    """One chain link: text read as ``wrong`` that was written as ``right``."""

    right: str
    wrong: str
    cost: int

    @property
    def name(self) -> str:
        return f"{self.right} read as {self.wrong}"


@dataclass
class Model:
    """What the description length needs: dictionaries and letters per language."""

    dictionaries: dict[str, bytes]
    letters: dict[str, set[str]]
    words: set[str]
    hands: Mender | None = field(default=None, repr=False, compare=False)

    def at_hand(self) -> Mender:
        """What applies the model in a Python worker; tasks that follow one another there share what it remembers."""
        if self.hands is None:
            self.hands = Mender(self)
        return self.hands


def fit(sentences: dict[str, list[str]], dictionary_bytes: int = DICTIONARY_BYTES) -> Model:
    """Train a dictionary per language, and list the letters that its sentences use (in either case)."""
    dictionaries, letters, tokens = {}, {}, Counter()
    for lang, own in sentences.items():
        samples = [s.encode() for s in own]
        try:
            dictionaries[lang] = zstandard.train_dictionary(dictionary_bytes, samples, level=3).as_bytes()
        except zstandard.ZstdError:  # too few sentences to train on: they are the dictionary themselves
            dictionaries[lang] = b" ".join(samples)[-dictionary_bytes:]
        seen = Counter(ch for s in own for ch in set(s) if ord(ch) > 127 and ch.isalpha())
        # a letter of one stray word is no letter of the language
        plain = [ch for ch, n in seen.items() if n >= max(3, len(own) // 400)] + list(ALPHABETS.get(lang, ""))
        letters[lang] = {x for ch in plain for x in (ch, *(c for c in (ch.upper(), ch.lower()) if len(c) == 1))}
        tokens.update(t for s in own for t in set(TOKEN.findall(s)))
    return Model(dictionaries, letters, {t for t, n in tokens.items() if n >= 3})


class Mender:
    """Finds and undoes garbling; one per Python worker."""

    def __init__(self, model: Model) -> None:
        self.letters = model.letters
        self.plain = {lang: own | SIGNS for lang, own in model.letters.items()}
        kind = lambda d: zstandard.DICT_TYPE_FULLDICT if d[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        self.compress = {}
        for lang, d in model.dictionaries.items():
            z = zstandard.ZstdCompressionDict(d, dict_type=kind(d))
            z.precompute_compress(level=3)
            self.compress[lang] = zstandard.ZstdCompressor(dict_data=z, write_content_size=False, write_dict_id=False, write_checksum=False).compress
        self.steps = [Step(right, wrong, cost) for right, wrongs, cost in STEPS for wrong in wrongs.split()]
        self.codecs = {name: _codec(name) for right, wrongs, _ in STEPS for name in (right, *wrongs.split()) if name != "utf-8"}
        # the steps that the first character beyond ASCII of a token leaves open: a byte that begins a sequence, or any
        self.open_to: dict[str, list[int]] = {}
        for i, x in enumerate(self.steps):
            for ch, byte in self.codecs[x.wrong][0].items():
                if byte > 127 and ord(ch) > 127 and (x.right != "utf-8" or 0xC2 <= byte <= 0xF4):
                    self.open_to.setdefault(ch, []).append(i)
        self.words = model.words
        self.moved: dict[tuple[str, int], str] = {}
        self.any_letter = set().union(*self.letters.values()) if self.letters else set()
        self.memory: dict[str, dict[int, str]] = {}
        self.inner: dict[str, int] = {}

    def orderly(self, token: str) -> bool:
        """If one language has all the letters, capitals stand where they may, and signs stand outside of words."""
        odd = [ch for ch in token if ord(ch) > 127]
        if any(ch not in self.any_letter and ch not in SIGNS for ch in odd):
            return False
        body = token.strip(_SIGNS)
        inner = [ch for ch in body if ord(ch) > 127]
        if any(ch in SIGNS and ch not in "’‘·– ­ ⁠​‌‍﻿‑" for ch in inner):
            return False
        alpha = [ch for ch in inner if ch not in SIGNS]
        if alpha and not any(all(ch in own for ch in alpha) for own in self.letters.values()):
            return False
        if alpha and "а" <= alpha[0].lower() <= "ё" and any(ch.isascii() and ch.isalpha() for ch in body):
            return False
        return not any(a.islower() and b.isupper() for a, b in zip(body, body[1:]))

    def undo(self, step: Step, text: str, strict: bool = True) -> str | None:
        """The text before the step; None if it can't have come from it. Not strict: broken sequences become U+FFFD."""
        to_byte, _ = self.codecs[step.wrong]
        try:
            raw = bytes([to_byte[ch] if ord(ch) > 127 else ord(ch) for ch in text])
        except KeyError:
            return None
        if step.right != "utf-8":
            return "".join(map(self.codecs[step.right][1].__getitem__, raw))
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            if strict:
                return None
            out = raw.decode("utf-8", "replace")
            good, bad = sum(ord(ch) > 127 for ch in out) - out.count("�"), out.count("�")
            return out if good > bad else None

    def _was(self, step: Step, token: str) -> str | None:
        """:meth:`undo`, also where a no-break space or soft hyphen, the second byte of à and í, has been lost."""
        was = self.undo(step, token)
        if was is None and step.right == "utf-8" and step.wrong in ("cp1252", "latin-1"):
            for whole in (_LOST_HYPHEN.sub("\\g<0>\xad", token), _LOST_SPACE.sub("\\g<0>\xa0", token)):
                if whole != token and (was := self.undo(step, whole)) is not None:
                    break
        return was

    def _plausible(self, step: Step, token: str, was: str) -> bool:
        """If a step that can't be verified by itself gave something that the token may well have been."""
        if not self.orderly(was):
            return False
        if any(ch in _BLANKS for ch in token) or any(ch.isascii() and ch.isalpha() for ch in token) and all(ch in _DISGUISE for ch in token if ord(ch) > 127):
            return False
        letters = [ch for ch in was if ord(ch) > 127 and ch.isalpha()]
        if not letters:
            # a sign: the token is a lone letter, or has a capital within
            return any(ch in LONE_SIGNS for ch in was) and not any("Ѐ" <= ch <= "ӿ" for ch in token) and (len(token) == 1 or not self.orderly(token))
        if any("а" <= ch.lower() <= "ё" for ch in letters):
            # short words give no evidence for another script; words that read as Cyrillic already are clean unless their capitals are odd
            already = "а" <= token[0].lower() <= "ё"
            if already and (self.orderly(token) and not token.isupper() or was.isupper() and not token.isupper()):
                return False
            return sum(map(str.isalpha, was)) > (3 if already else 2)
        return len(token) > 1 or not self.orderly(token)

    def candidates(self, token: str) -> dict[int, str]:
        """Step number -> what the token was, for steps that give something orderly, or again something a step can undo."""
        got = self.memory.get(token)
        if got is None:
            got = {}
            for i in self.open_to.get(_ODD.search(token).group(), ()) if token not in self.words else ():
                s = self.steps[i]
                was = self._was(s, token)
                if was is None or was == token:
                    continue
                if s.right == "utf-8":
                    if all(ch in self.any_letter or ch in SIGNS or ord(ch) < 128 for ch in was) or any(self.undo(t, was) not in (None, was) for t in self.steps if t.right == "utf-8"):
                        got[i] = was
                elif self._plausible(s, token, was):
                    got[i] = was
            if len(self.memory) > REMEMBERED:
                self.memory.clear()
                self.moved.clear()
            self.memory[token] = got
        return got

    def _inner(self, token: str) -> int:
        """Signs and capitals within a word."""
        n = self.inner.get(token)
        if n is None:
            if len(self.inner) > REMEMBERED:
                self.inner.clear()
            body = token.strip(_SIGNS)
            n = self.inner[token] = sum(ch in SIGNS and ch not in _JOINING for ch in body) + sum(map(len, _CAPITAL.findall(body)))
        return n

    def _escapes(self, text: str) -> dict[str, int]:
        """Per language, how many characters it must escape: unknown letters, and signs or capitals within words."""
        odd = Counter(_ODD.findall(text))
        inner = sum(map(self._inner, TOKEN.findall(text)))
        return {lang: 2 * inner + sum(map(odd.__getitem__, odd.keys() - own)) for lang, own in self.plain.items()}

    def length(self, text: str, below: float = math.inf) -> float:
        """Description length in bytes under the best of all languages; infinite if the escapes alone cost ``below`` or more."""
        raw = text.encode("utf-8", "surrogatepass")
        best = None
        for lang, n in sorted(self._escapes(text).items(), key=lambda x: x[1]):
            if ESCAPE * n >= (below if best is None else best):
                # the escapes alone cost more, here and in all that follow
                best = math.inf if best is None else best
                break
            size = len(self.compress[lang](raw)) + ESCAPE * n
            best = size if best is None else min(best, size)
        return len(raw) if best is None else best

    def _undone(self, text: str) -> Iterator[tuple[Step, int, str]]:
        """(step, its cost, the text before it) for every step that some token of a text speaks for."""
        pieces = _TOKENS.split(text)  # every other piece is a token
        own = set(pieces[1::2])
        spoken_for = {i for t in own for i in self.candidates(t)}
        for i in sorted(spoken_for, key=lambda i: (self.steps[i].cost, i)):
            step = self.steps[i]
            was = {t: self._mended(t, i) for t in own}
            pieces[1::2], tokens = map(was.__getitem__, pieces[1::2]), pieces[1::2]
            new = "".join(pieces)
            pieces[1::2] = tokens
            cost = step.cost
            if step.right != "utf-8":
                # a letter for a letter: the old text reads as words as well, so each kind of exchange must earn its keep
                swaps = {(a, b) for a, b in zip(text, new) if a != b}
                cost += 3 * sum(a.lower() != a.upper() and b.isalpha() and a.isupper() == b.isupper() and not "а" <= b.lower() <= "ё" for a, b in swaps)
            yield step, cost, new

    def mend_passage(self, text: str) -> tuple[str, list[str]]:
        """(text, names of the steps undone) of one passage; unchanged without steps if no chain describes it in fewer bytes.

        All chains of up to ``LONGEST`` steps are described, also those whose first steps don't pay by themselves; a text that
        several chains lead to is described once, with the cheapest of the shortest of them.
        """
        best, after, done = self.length(text) if any(map(self.candidates, set(TOKEN.findall(text)))) else 0, text, ()
        seen, open_ = {text}, {text: (0, ())}
        for nth in range(1, LONGEST + 1 if best else 1):
            then: dict[str, tuple[int, tuple[str, ...]]] = {}
            for old, (paid, names) in open_.items():
                for step, cost, new in self._undone(old):
                    cost *= nth  # the longer a chain, the more there are
                    if new not in seen and (new not in then or paid + cost < then[new][0]):
                        then[new] = paid + cost, (*names, step.name)
            for new, (paid, names) in then.items():
                if len(text) == len(new) and all(a in _DISGUISE or a in SIGNS and b in SIGNS for a, b in zip(text, new) if a != b):
                    continue  # a chain that in the end puts signs for signs, or something for disguised letters, proves nothing
                if (size := self.length(new, best - paid) + paid) < best:
                    best, after, done = size, new, names
            seen.update(then)
            open_ = then
        return after, list(done)

    def _mended(self, token: str, i: int) -> str:
        got = self.moved.get((token, i))
        if got is None:
            step = self.steps[i]
            got = self.candidates(token).get(i)
            if got is None and token not in self.words:
                # the chain holds for its whole passage: tokens too short to speak for it follow, broken ones as far as they go
                got = self.undo(step, token, strict=False)
                if got is not None and step.right != "utf-8" and not self.orderly(got):
                    got = None
            got = self.moved[token, i] = token if got is None else got
        return got

    def mend(self, text: str) -> tuple[str, str | None]:
        """(restored text, chain or None if nothing was garbled). Passages that can't be restored count with the chain ``lost``."""
        if text.isascii():
            return text, None
        if not CERTAIN.search(text) and not any(self.candidates(t) for t in set(TOKEN.findall(text))):
            return text, None
        names: list[str] = []
        parts = _PARAGRAPH.split(text)
        lost = False
        for k in range(0, len(parts), 2):
            if parts[k].isascii():
                continue
            parts[k], done = self.mend_passage(parts[k])
            names += done
            lost = lost or self._lost(parts[k])
        return "".join(parts), "; ".join(dict.fromkeys([*names, "lost"] if lost else names)) or None

    def _lost(self, text: str) -> bool:
        """If a passage is described in fewer bytes as one from which characters were lost, each at a byte, than as it stands."""
        n = len(CERTAIN.findall(text))
        return n > 0 and self.length(CERTAIN.sub("", text)) + 1 + n < self.length(text)


def restore(df: DataFrame, column: str, model: Model, result: str = "restored", chain: str = "chain") -> DataFrame:
    """``df`` with ``result``, the text of ``column`` as it was meant, and ``chain``, the steps undone; null if it was not garbled.

    Null gives null; empty stays. ``lost`` in the chain says that characters are gone for good. Other columns pass through;
    ``result`` and ``chain`` replace columns of those names. A map over Arrow batches with a model of bounded size.
    """
    kept = [c for c in df.columns if c not in (result, chain) or c == column]
    if column in (result, chain):
        raise ValueError("the results need names of their own")
    at = kept.index(column)
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(result, T.StringType()), T.StructField(chain, T.StringType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mender = shared.value.at_hand()
        for b in batches:
            out = [(None, None) if t is None else mender.mend(t) for t in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in out], pa.string()), pa.array([c for _, c in out], pa.string())], names=[*kept, result, chain])

    return spread(df.select(*kept)).mapInArrow(apply, schema)


def fit_on(documents: DataFrame) -> Model:
    """A model from labelled texts (``lang``, ``text``); see :mod:`sievewright.llm.langdata` for its bounds."""
    return fit(labelled_sentences(documents))
