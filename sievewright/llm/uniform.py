"""One consistent form for text that looks the same but differs in its characters.

Whole Arrow batches become numpy code-point arrays. Lookup tables say for each code point whether it stays, goes,
becomes a space or expands to other code points; expansion offsets lay the result out; combining marks are
composed for all rows at once; and per-word counts of scripts, gathered by lookup as well, find
letters of one script that stand in for those of another. No string function runs per row.

What changes: full-width and other presentation variants of letters, digits and ASCII signs; combining
marks that compose; invisible format characters (dropped); spaces other than U+0020; stand-in letters. What stays:
genuine words of any script, superscripts, fractions, ligatures, signs, dashes, quotes, line breaks, control characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sievewright.llm.arrowtext import code_points, slices, strings

#: Tables reach to here; above, only tags and variation selectors matter, which are dropped.
LIMIT = 0x20000
STAYS, GOES, SPACE, VARIANT, MARK = range(5)
LATIN, CYRILLIC, GREEK = 1, 2, 3

# Compatibility tags of the Unicode Character Database that mark presentation variants.
VARIANT_TAGS = {"<wide>", "<narrow>", "<font>", "<small>", "<vertical>", "<circle>", "<initial>", "<medial>", "<final>", "<isolated>"}
# Blocks of combining diacritical marks.
MARK_BLOCKS = ((0x0300, 0x036F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF), (0xFE20, 0xFE2F))
# Letters that look like a Latin one, in pairs.
CYRILLIC_AS_LATIN = "АA ВB СC ЕE НH ІI ЈJ КK МM ОO РP ЅS ТT ХX УY аa сc еe оo рp хx уy іi јj ѕs һh ԁd ԛq ԝw ёë їï ЇÏ ЁË ӏl ԌG ԚQ ԜW кk"
GREEK_AS_LATIN = "ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX οo νv αa ρp ιi υu κk χx γy"
# The letters of modern Russian; other Cyrillic letters mark a stand-in in a wholly look-alike word.
RUSSIAN = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯабвгдеёжзийклмнопрстуфхцчшщъыьэюя"
# What a UTF-8 lead byte becomes in a one-byte code page; a no-break space or soft hyphen after it is garble, not disguise.
LEADS = "ÂÃÄÅÐÑâÎÏÉ├┬┼─√¬ƒĂĹ"
# Cyrillic readings of UTF-8 lead bytes, and signs that their trail bytes become.
CYRILLIC_LEADS = "ГДЕВРСО"
CYRILLIC_PAGES = "РС"
TRAILS = "‚›„‡‰¤¦§©¬®±µ¶·™°€†"


class Tables:
    """Lookup tables, built by rule from the Unicode data of the interpreter."""

    def __init__(self) -> None:
        kind = np.zeros(LIMIT, np.uint8)
        script = np.zeros(LIMIT, np.uint8)
        ccc = np.zeros(LIMIT, np.uint8)
        lower = np.zeros(LIMIT, bool)
        first = np.zeros(LIMIT, np.int64)
        length = np.ones(LIMIT, np.int64)
        pool: list[int] = []
        pairs: dict[int, int] = {}
        for c in range(0x80, LIMIT):
            ch = chr(c)
            cat = unicodedata.category(ch)
            if cat in ("Cn", "Co", "Cs"):
                continue
            if cat == "Zs":
                kind[c] = SPACE
                continue
            if cat == "Cf" and not (0x600 <= c <= 0x605 or c in (0x6DD, 0x70F, 0x8E2, 0x110BD, 0x110CD)) or 0xFE00 <= c <= 0xFE0F or c == 0x34F:
                kind[c], length[c] = GOES, 0
                continue
            parts = unicodedata.decomposition(ch).split()
            if parts and parts[0] in VARIANT_TAGS:
                to = unicodedata.normalize("NFKC", ch)
                if len(to) == 1 or parts[0] == "<circle>" and to.isascii():
                    kind[c], first[c], length[c] = VARIANT, len(pool), len(to)
                    pool += map(ord, to)
            elif len(parts) == 1 and parts[0][0] != "<" and cat[0] == "L":
                kind[c], first[c] = VARIANT, len(pool)
                pool.append(ord(unicodedata.normalize("NFC", ch)))
            elif len(parts) == 2 and parts[0][0] != "<" and unicodedata.normalize("NFC", ch) == ch:
                a, b = (int(x, 16) for x in parts)
                pairs[a << 21 | b] = c
            if any(a <= c <= b for a, b in MARK_BLOCKS):
                kind[c] = MARK
                ccc[c] = unicodedata.combining(ch)
            if cat[0] == "L" and c < 0x2000:
                name = unicodedata.name(ch, "")
                script[c] = LATIN if name.startswith("LATIN") else CYRILLIC if name.startswith("CYRILLIC") else GREEK if name.startswith("GREEK") else 0
                lower[c] = cat == "Ll"
        for c in (*range(65, 91), *range(97, 123)):
            script[c], lower[c] = LATIN, c > 96
        self.kind, self.script, self.ccc, self.lower, self.first, self.length = kind, script, ccc, lower, first, length
        self.pool = np.array(pool, np.uint32)
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_to = keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)
        same = np.arange(LIMIT, dtype=np.uint32)
        self.to_latin, self.to_cyrillic = same.copy(), same.copy()
        for a, b in (x for x in f"{CYRILLIC_AS_LATIN} {GREEK_AS_LATIN}".split()):
            self.to_latin[ord(a)] = ord(b)
        latin_to = {}
        for a, b in CYRILLIC_AS_LATIN.split():
            latin_to.setdefault(b, a)
        for b, a in latin_to.items():
            self.to_cyrillic[ord(b)] = ord(a)
        for a, b in GREEK_AS_LATIN.split():
            if b in latin_to:
                self.to_cyrillic[ord(a)] = ord(latin_to[b])
        self.hard_for_latin = (script > LATIN) & (self.to_latin == same)
        self.hard_for_cyrillic = ((script == LATIN) | (script == GREEK)) & (self.to_cyrillic == same)
        self.foreign = script == CYRILLIC
        for ch in RUSSIAN:
            self.foreign[ord(ch)] = False
        mark = lambda s: self._set(s)
        self.leads, self.cyrillic_leads, self.trails, self.pages = mark(LEADS), mark(CYRILLIC_LEADS), mark(TRAILS), mark(CYRILLIC_PAGES)

    @staticmethod
    def _set(chars: str) -> np.ndarray:
        t = np.zeros(LIMIT, bool)
        t[[ord(c) for c in chars]] = True
        return t


@lru_cache(maxsize=1)
def tables() -> Tables:
    """Built once per Python worker."""
    return Tables()


def _compose(t: Tables, out: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Compose each mark with the base before it, in the order of the text; what does not compose stays."""
    at = np.flatnonzero(t.kind[np.minimum(out, LIMIT - 1)] == MARK)
    keep = np.ones(len(out), bool)
    if not len(at):
        return out, keep
    fresh = np.ones(len(at), bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (row[at[1:]] != row[at[:-1]])
    run = np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    base = at - run - 1
    good = (base >= 0) & (row[np.maximum(base, 0)] == row[at])
    out, blocked = out.copy(), np.zeros(len(out), np.uint8)
    for k in range(int(run.max()) + 1):
        s = good & (run == k)
        if not s.any():
            continue
        i, b = at[s], base[s]
        key = out[b].astype(np.int64) << 21 | out[i]
        p = np.minimum(np.searchsorted(t.pair_keys, key), len(t.pair_keys) - 1)
        hit = (t.pair_keys[p] == key) & (blocked[b] < np.maximum(t.ccc[out[i]], 1))
        out[b[hit]] = t.pair_to[p[hit]]
        keep[i[hit]] = False
        blocked[b[~hit]] = np.maximum(blocked[b[~hit]], t.ccc[out[i[~hit]]])
    return out, keep


def _unmask(t: Tables, out: np.ndarray, row: np.ndarray, n: int, case: np.ndarray) -> np.ndarray:
    """Put stand-in letters back into their word's script; marks the rows in ``case``."""
    script = t.script[np.minimum(out, LIMIT - 1)]
    touched = np.zeros(n, bool)
    touched[row[script > LATIN]] = True
    pos = np.flatnonzero((script > 0) & touched[row]) if touched.any() else np.zeros(0, np.int64)
    if not len(pos):
        return out
    fresh = np.ones(len(pos), bool)
    fresh[1:] = (pos[1:] != pos[:-1] + 1) | (row[pos[1:]] != row[pos[:-1]])
    first = np.flatnonzero(fresh)
    word, letters, s = np.cumsum(fresh) - 1, out[pos], script[pos]
    add = lambda x: np.add.reduceat(x.astype(np.int32), first)
    size, latin, cyrillic = add(np.ones(len(pos))), add(s == LATIN), add(s == CYRILLIC)
    not_latin, not_cyrillic = add(t.hard_for_latin[letters]), add(t.hard_for_cyrillic[letters])
    foreign, lower = add(t.foreign[letters]), add(t.lower[letters])
    of = row[pos[first]]
    last = pos[np.concatenate((first[1:], [len(pos)])) - 1]
    after = np.minimum(last + 1, len(out) - 1)
    garbled = t.cyrillic_leads[np.minimum(out[last], LIMIT - 1)] & t.trails[np.minimum(out[after], LIMIT - 1)] & (row[after] == of)
    row_cyrillic = np.zeros(n, bool)
    could_latin, could_cyrillic = not_latin == 0, (not_cyrillic == 0) & (cyrillic > 0)
    row_cyrillic[of[(not_latin > 0) & ((latin == 0) | could_cyrillic)]] = True
    mixed = (latin > 0) & (latin < size) & ~garbled
    prefers_cyrillic = row_cyrillic[of] & (cyrillic >= latin)
    to_cyrillic = mixed & could_cyrillic & (~could_latin | prefers_cyrillic)
    to_latin = mixed & could_latin & ~to_cyrillic
    # a word wholly of look-alikes, in a text without a word that can only be Cyrillic or Greek; capitals of Russian alone may be a genuine short form
    to_latin |= (latin == 0) & could_latin & ~row_cyrillic[of] & ~garbled & ((lower > 0) | (foreign > 0) | (cyrillic == 0) | (size == 1))
    # a small Latin look-alike word between two words that can only be Cyrillic
    hard = (not_latin > 0) & (latin == 0)
    between = np.zeros(len(first), bool)
    if len(first) > 2:
        begin = pos[first]
        between[1:-1] = hard[:-2] & hard[2:] & (of[:-2] == of[1:-1]) & (of[2:] == of[1:-1]) & (begin[1:-1] == last[:-2] + 2) & (begin[2:] == last[1:-1] + 2)
    to_cyrillic |= between & (latin == size) & (not_cyrillic == 0) & (lower == size)
    if not (to_latin.any() or to_cyrillic.any()):
        return out
    out = out.copy()
    i = pos[to_latin[word]]
    out[i] = t.to_latin[out[i]]
    i = pos[to_cyrillic[word]]
    out[i] = t.to_cyrillic[out[i]]
    case[of[to_latin | to_cyrillic]] = True
    return out


def consistent(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code points, starts, rows that were not in consistent form) for texts laid end to end.

    The form is stable: applied again it changes nothing, though a mark that no letter composes with still counts as a case.
    """
    t, n = tables(), len(starts) - 1
    case = np.zeros(n, bool)
    if not len(points) or points.max() < 128:
        return points, starts, case
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    low = np.minimum(points, LIMIT - 1)
    kind, length = t.kind[low], t.length[low]
    high = (points >= 0xE0000) & (points < 0xE0200)
    kind[high], length[high] = GOES, 0
    odd = np.flatnonzero((points == 0xA0) | (points == 0xAD))
    if len(odd):
        before, after = np.maximum(odd - 1, 0), np.minimum(odd + 1, len(points) - 1)
        # Cyrillic read as another Cyrillic page: the lead bytes become two letters, before and after
        leads = t.leads[low[before]] | t.pages[low[before]] & t.pages[low[after]] & (row[after] == row[odd])
        odd = odd[(odd > 0) & leads & (row[before] == row[odd])]
        kind[odd], length[odd] = STAYS, 1
    case[row[kind != STAYS]] = True
    if case.any():
        total = np.cumsum(length)
        source = np.repeat(np.arange(len(points)), length)
        inner = np.arange(len(source)) - (total - length)[source]
        out, how = points[source], kind[source]
        out[how == SPACE] = 0x20
        v = how == VARIANT
        out[v] = t.pool[t.first[low[source[v]]] + inner[v]]
        row = row[source]
        out, keep = _compose(t, out, row)
        out, row = out[keep], row[keep]
    else:
        out = points
    out = _unmask(t, out, row, n, case)
    return out, np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))), case


def to_consistent(df: DataFrame, column: str, result: str = "consistent", changed: str = "inconsistent") -> DataFrame:
    """``df`` with ``result``, the text of ``column`` in consistent form, and ``changed``, if it was not in that form.

    All other columns pass through; ``result`` and ``changed`` replace columns of those names. Null gives null and
    false, empty gives empty and false. One map over Arrow batches: nothing is shuffled.
    """
    kept = [c for c in df.columns if c not in (result, changed) or c == column]
    at = kept.index(column)
    if column in (result, changed):
        raise ValueError("the results need names of their own")
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(result, T.StringType()), T.StructField(changed, T.BooleanType())])

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = np.diff(np.frombuffer(whole.column(at).buffers()[1], np.int32)[whole.column(at).offset :][: len(whole) + 1]) if len(whole) else np.zeros(0, int)
            for i, j in slices(lengths):
                b = whole.slice(i, j - i)
                col = b.column(at)
                out, starts, case = consistent(*code_points(col))
                valid = col.is_valid().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([*b.columns, strings(out, starts, valid), pa.array(case)], names=[*kept, result, changed])

    return df.select(*kept).mapInArrow(apply, schema)
