"""Only the text that a sender newly wrote: without quoted history, signatures and disclaimers.

A body is cut into blocks: paragraphs, cut again where quote marks begin or end and at rules, separators and headers. Each
block is described by numbers: quote depth, density of contact data, headers, rules, its place and what precedes and follows
it, how often its sender sends a block of that pattern (sender frequency), and which of its sentences earlier mails of others or of
the sender have (ancestor overlap). Gradient-boosted trees tell blocks that are not the sender's.

There are no labels, so the trees are fitted on a bounded sample of mails that layout marks label, and on copies of some of them
from which those marks were taken: quote marks, headers, separators, introductions and rules. A copy keeps the labels of its
lines, so that what the trees learn from it is not what made the label: frequencies, ancestors, contacts, place and form decide there.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.llm.garble import STEPS
from sievewright.session import spread
from sievewright.staging import written

#: Mails that the trees are fitted on, about, and the part of them that is also taken without its marks.
SAMPLE_MAILS, STRIPPED = 6_000, 0.25
#: A key that more than this part of all rows has is joined by broadcast; there are fewer of them than this.
HOT = 1_000


def _garbled(sign: str) -> set[str]:
    """What a sign looks like after each wrong decoding."""
    out = set()
    for right, wrongs, _ in STEPS:
        for wrong in wrongs.split():
            raw = sign.encode(right, "ignore")
            s = raw.decode(wrong, "ignore").strip()
            if s and s != sign and not all(unicodedata.category(ch) in ("Lu", "Ll", "Nd") for ch in s):
                out.add(s)
                out.add(s.encode("utf-8").decode("cp1252", "ignore"))
    return out


_MARKS = sorted({">", "|", "»", *_garbled("»")}, key=len, reverse=True)
_MARK = "(?:" + "|".join(map(re.escape, _MARKS)) + ")"
# a mark that was lost stands as U+FFFD, alone before a blank, another mark or the end
_LOST = "\ufffd(?=[ \t>|]|$)"
QUOTE = re.compile(rf"^[ \t]*(?:{_MARK}|{_LOST})(?:[ \t]?(?:{_MARK}|{_LOST}))*")
ONE_MARK = re.compile(f"{_MARK}|\ufffd")
RULE = re.compile(r"^\s*[-_=*~#+.—–]{2,}\s*$")
SEPARATOR = re.compile(r"^\s*([-_=*]{4,})\s*\S.*?\S\s*[-_=*]{4,}\s*$")
# a name of one or two words and a colon; a garbled one has signs in it
HEADER = re.compile(r"^\s*\*?([^\s\d!-/:-@\[-`{-~][^\s\d:@<>|]{0,16}(?: [^\s\d:@<>|]{1,12})?)\s?:\*?(?=\s|$)")
ADDRESS = re.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]+\.\w+")
CONTACT = re.compile(r"(?<![\w.+-])[\w.+-]++@[\w-]+\.\w+|\+\d[\d /()-]{5,}|\b(?:tel|fon|phone|fax|mobil|www)\b|https?://|[|·]")
NAME = re.compile(r"^\s*(?:[^\W\d_]\.\s?)?[^\W\d_][\w’'-]+(?:\s+[^\W\d_][\w’'-]+)?\s*$")
# a garbled initial or name has signs in it
INITIAL = re.compile(r"^\s*[^\s\d.]{1,3}\.\s?[^\s\d@|,;:<>]{2,40}\s*$")
_INVISIBLE = re.compile("[\xad\u200b-\u200f\u2060-\u2064\ufeff]")
DATED = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}\.? [^\W\d_]{3,} \d{4}|[^\W\d_]{3,} \d{1,2}, \d{4}")
SENTENCE = re.compile(r"[.!?…][\"'“”»)]*$")
_BETWEEN = re.compile(r"[.!?:;]+\s+")
#: Characters of a sentence that may tell an ancestor.
LEAST_SENTENCE = 20
_WORD, _DIGIT = re.compile(r"\w+"), re.compile(r"\d")

FEATURES = (
    "depth", "enclosed", "in_forward", "separator", "rule", "header_share", "introduces", "contact_density", "n_lines", "mean_length", "after_closing", "after_rule",
    "ends_sentence", "blocks_after", "place", "capital_share", "names", "closing", "digit_share", "longest", "quoted_before", "quoted_after", "before_contact", "first_own", "closes_after",
    "marked_mail", "sentences",
    "sender_frequency", "ancestor_overlap", "own_overlap", "commonness",
)
#: The features that need other messages stand last.
OWN = len(FEATURES) - 4


def _contacts(text: str) -> int:
    """How many contact data a text has; most have none of the signs that all of them need."""
    low = text.lower()
    if not any(sign in low for sign in ("@", "|", "·", "+", "tel", "fon", "phone", "fax", "mobil", "www", "http")):
        return 0
    return len(CONTACT.findall(low))


@dataclass
class Block:
    """Lines from ``first`` to ``last`` (from 0) and what is known of them."""

    first: int
    last: int
    depth: int
    lines: list[str]
    kind: str = "text"  # text, rule, separator, headers
    words: list[str] | None = None


def blocks_of(text: str) -> list[Block]:
    """The blocks of a body; blank lines belong to none, but a line that has only a quote mark does."""
    out: list[Block] = []
    open_ = False
    for i, line in enumerate(text.split("\n")):
        if not line.strip():
            open_ = False
            continue
        m = QUOTE.match(line)
        depth = len(ONE_MARK.findall(m.group())) if m else 0
        body = (line[m.end() :] if m else line).strip()
        kind = "text"
        if not depth:
            if RULE.match(body):
                kind = "rule"
            elif len(body) < 300 and SEPARATOR.match(body) and body[:2] != "-- ":
                kind = "separator"
            elif (h := HEADER.match(body)) and (not SENTENCE.search(body) or ADDRESS.search(body)) and len(body) > h.end():
                kind = "headers"
        last = out[-1] if out else None
        if open_ and last and (last.depth > 0) == (depth > 0) and last.kind == kind and kind != "rule":
            last.last = i
            last.lines.append(body)
            last.depth = min(last.depth, depth)
        else:
            out.append(Block(i, i, depth, [body], kind))
        open_ = True
    # a lone line with a colon is no header, unless it carries an address
    for k, b in enumerate(out):
        if b.kind == "headers" and len(b.lines) < 2 and not (k and out[k - 1].kind in ("rule", "separator") and out[k - 1].last == b.first - 1):
            b.kind = "text"
    return out


def _is_closing(b: Block) -> bool:
    """A short formula and a name under it, or a name alone under a formula."""
    if b.kind != "text" or b.depth or not 2 <= len(b.lines) <= 3:
        return False
    head, name = b.lines[0], b.lines[-1]
    if INITIAL.match(head):
        return False
    return bool(INITIAL.match(name) or NAME.match(name) and " " in name.strip() and len(name) < 40) and len(head) < 45 and not re.search(r"[\d@|]|[.!?:]$", head) and head[-1:] != ","


def describe(text: str) -> tuple[list[Block], np.ndarray, list[int]]:
    """(blocks, their features but for those that need other messages, labels 1 not the sender's, 0 the sender's, -1 not sure)."""
    text = text.replace("\r", "")
    if not text.isascii():
        text = unicodedata.normalize("NFC", _INVISIBLE.sub("", text))
    blocks = blocks_of(text)
    n = len(blocks)
    x = np.zeros((n, len(FEATURES)), np.float32)
    labels = [-1] * n
    forward = closing_seen = False
    n_own = 0
    flat = [" ".join(b.lines) for b in blocks]
    # marks alone tell quoted blocks; they need no look at their words
    contact = [0 if b.depth else _contacts(t) for b, t in zip(blocks, flat)]
    quoted = [b.depth > 0 for b in blocks]
    any_mark = any(quoted) or any(b.kind != "text" for b in blocks)
    marked = next((k for k, b in enumerate(blocks) if b.kind in ("headers", "separator")), n)
    closes = [k < marked and not (k and blocks[k - 1].kind == "rule") and _is_closing(b) for k, b in enumerate(blocks)]
    for k, b in enumerate(blocks):
        t = flat[k]
        before, after = (blocks[k - 1] if k else None), (blocks[k + 1] if k + 1 < n else None)
        tight_before, tight_after = bool(before and before.last == b.first - 1), bool(after and after.first == b.last + 1)
        enclosed = not b.depth and tight_before and quoted[k - 1] and (tight_after and quoted[k + 1] or len(b.lines) == 1 and not b.lines[0][:1].isupper())
        # text between quoted lines without a blank line was wrapped out of the quote, as was a small-lettered line right under it
        introduces = not b.depth and bool(after) and quoted[k + 1] and t.endswith(":") and len(b.lines) <= 4
        if b.kind in ("separator",) or b.kind == "headers" and (len(b.lines) > 2 or any(ADDRESS.search(y) for y in b.lines) or before is not None and before.kind in ("rule", "separator") and tight_before):
            forward = True
        unmarked = not b.depth and not introduces and t.endswith(":") and bool(DATED.search(t)) and (bool(ADDRESS.search(t)) or len(b.lines) <= 2 and len(t) < 90 and bool(re.search(r"[^\W\d_]\. [^\W\d_]+|[^\W\d_]+ [^\W\d_]+:$", t))) and bool(after)
        if unmarked and not tight_before:
            forward = True
        next_forward = b.kind == "rule" and after is not None and after.kind == "headers" and tight_after
        after_rule = bool(before and before.kind == "rule" and tight_before and not forward)
        closing = not forward and not after_rule and _is_closing(b)
        row = x[k]
        row[25] = any_mark
        if b.depth:
            row[0], row[8], row[13], row[14] = b.depth, len(b.lines), n - 1 - k, k / n
            labels[k] = 1
            continue
        words = b.words = _WORD.findall(t)
        row[:25] = (
            b.depth, enclosed, forward or next_forward, b.kind == "separator", b.kind == "rule", sum(bool(HEADER.match(y)) for y in b.lines) / len(b.lines), introduces or unmarked,
            10 * contact[k] / max(1, len(words)), len(b.lines), len(t) / len(b.lines), closing_seen, after_rule,
            bool(SENTENCE.search(t)), n - 1 - k, k / n, sum(map(str.isupper, [w[0] for w in words])) / max(1, len(words)), sum(bool(NAME.match(y)) for y in b.lines) / len(b.lines), closing,
            len(_DIGIT.findall(t)) / max(1, len(t)), max(map(len, b.lines)), any(quoted[:k]), any(quoted[k + 1 :]), contact[k + 1] / max(1, len(blocks[k + 1].lines)) if after else 0, not n_own, any(closes[k + 1 :]),
        )
        if b.depth or enclosed or introduces or unmarked or forward or next_forward or b.kind == "rule" or after_rule:
            labels[k] = 1
        elif closing_seen or contact[k] > 1 and not SENTENCE.search(t):
            # after the name comes what a program adds; a further paragraph before another closing would be the sender's
            labels[k] = int(not (closing or any(closes[k + 1 :])))
        elif k and not closing and len(b.lines) == 1 and not SENTENCE.search(t) and len(t) < 60 and t[-1:] not in ",:":
            labels[k] = -1  # a lone short line: a title or a notice of a device
        else:
            labels[k] = 0
        if closing or after_rule:
            closing_seen = True
        n_own += labels[k] == 0
    return blocks, x, labels


def pattern_key(sender: str, block: Block) -> int:
    """A hash of the sender and the pattern of a block: its words without capitals and digits."""
    small = " ".join(w if w.islower() else "X" for w in block.words or _WORD.findall(" ".join(block.lines)))
    return xxhash.xxh3_64_intdigest(f"{sender}\x00{small}") - (1 << 63)


def sentence_keys(block: Block) -> list[int]:
    """Hashes of the sentences of a block that are long enough to be told from others, however their lines are wrapped."""
    cut = (s.rstrip(" .!?:;") for s in _BETWEEN.split(" ".join(block.lines)))
    return [xxhash.xxh3_64_intdigest(s) - (1 << 63) for s in cut if len(s) >= LEAST_SENTENCE]


def stripped(text: str) -> tuple[str, list[int]] | None:
    """(the text without quote marks, headers, separators, introductions and rules, the label of each of its lines; -1 for blank ones); None if it has no marks."""
    text = text.replace("\r", "")
    blocks, x, labels = describe(text)
    if not x[:, FEATURES.index("marked_mail")].any():
        return None
    lines = text.split("\n")
    out, of, end, was = [], [], -1, 0
    for b, row, label in zip(blocks, x, labels):
        if b.kind != "text" or row[FEATURES.index("introduces")]:
            continue
        # a blank line where there was one, or where marks alone stood between
        if out and (b.first > end + 1 or label != was):
            out.append("")
            of.append(-1)
        for line in lines[b.first : b.last + 1]:
            m = QUOTE.match(line)
            plain = line[m.end() :].strip() if m else line
            out.append(plain)
            of.append(label if plain.strip() else -1)
        end, was = b.last, label
    return "\n".join(out), of


def _labels_of(blocks: list[Block], lines: list[int]) -> list[int]:
    return [max(own, key=own.count) if (own := [v for v in lines[b.first : b.last + 1] if v >= 0]) else -1 for b in blocks]


@dataclass
class Trees:
    """Boosted regression trees of equal depth as arrays: per tree and inner node a feature and a bound, per leaf a value."""

    feature: np.ndarray
    bound: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.start)
        row = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1]))
        for f, b, v in zip(self.feature, self.bound, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, f[node]] > b[node])
            out += v[node - (len(v) - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, least: float = 4.0) -> Trees:
    """Gradient boosting of the logistic loss with second-order leaf values, on binned features."""
    n, m = x.shape
    n_inner, n_leaf = 2**depth - 1, 2**depth
    share = float(np.clip(y.mean() if n else 0.5, 0.01, 0.99))
    start = float(np.log(share / (1 - share)))
    feature, bound, leaf = np.zeros((n_trees, n_inner), np.int64), np.full((n_trees, n_inner), np.inf, np.float32), np.zeros((n_trees, n_leaf))
    if not n:
        return Trees(feature, bound, leaf, start)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    edges = [np.unique(np.concatenate((e, np.unique(x[:, j])[: bins // 2]))) for j, e in enumerate(edges)]
    width = max(map(len, edges)) + 1
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    score = np.full(n, start)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            k = 2**level
            local = node - (k - 1)
            flat = (local[:, None] * m + np.arange(m)) * width + binned
            gs = np.bincount(flat.ravel(), np.repeat(g, m), k * m * width).reshape(k, m, width)
            hs = np.bincount(flat.ravel(), np.repeat(h, m), k * m * width).reshape(k, m, width)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            ga, ha = gl[..., -1:], hl[..., -1:]
            gain = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
            gain[(hl < least / 8) | (ha - hl < least / 8)] = 0
            for i in range(k):
                j, b = np.unravel_index(int(gain[i].argmax()), (m, width))
                if gain[i, j, b] > 1e-6 and b < len(edges[j]):
                    feature[t, k - 1 + i], bound[t, k - 1 + i] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > bound[t, node])
        local = node - n_inner
        leaf[t] = -rate * np.bincount(local, g, n_leaf) / (np.bincount(local, h, n_leaf) + 1)
        score += leaf[t][local]
    return Trees(feature, bound, leaf, start)


MAILS = "msg_id bigint, variant int, sampled boolean, sent bigint, who bigint, first binary, last binary, x binary, label binary, keys array<struct<key:bigint,place:int>>"
_KEYS = pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int32())]))
_TYPES = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), *[pa.binary()] * 4, _KEYS]


def _described(text: str, who: str, labels_of: list[int] | None = None) -> tuple:
    """(first lines, last lines, features, labels, keys) of a body; place is 2 * block for a sentence and 2 * block + 1 for the pattern."""
    blocks, x, labels = describe(text)
    keys = []
    for k, b in enumerate(blocks):
        if b.kind == "text" or b.depth:
            own = sentence_keys(b)
            x[k, FEATURES.index("sentences")] = len(own)
            keys += [{"key": h, "place": 2 * k} for h in own]
            if not b.depth and not x[k, 2]:
                keys.append({"key": pattern_key(who, b), "place": 2 * k + 1})
    if labels_of is not None:
        labels = _labels_of(blocks, labels_of)
    pack = lambda v, t: np.array(v, t).tobytes()
    return pack([b.first for b in blocks], np.int32), pack([b.last for b in blocks], np.int32), np.minimum(x[:, :OWN], 60_000).astype(np.float16).tobytes(), pack(labels, np.int8), keys


def described_mails(mails: DataFrame, share: float, key: str, body: str, sender: str, sent: str) -> DataFrame:
    """One row per mail with its blocks (variant 0), and one more without its marks (variant 1) for a part of the sample."""
    most = 1 << 40

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, text, who, at in zip(*(b.column(c).to_pylist() for c in range(4))):
                if i is None or not text or not text.strip():
                    continue
                draw = xxhash.xxh3_64_intdigest(str(i)) % most
                head = (draw < share * most, at, xxhash.xxh3_64_intdigest(who or "") - (1 << 63))
                rows.append((i, 0, *head, *_described(text, who or "")))
                if draw < share * STRIPPED * most and (bare := stripped(text)):
                    rows.append((i, 1, *head, *_described(bare[0], who or "", bare[1])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(_TYPES), _TYPES)], names=[c.split()[0] for c in MAILS.split(", ")])

    at = F.unix_micros(F.col(sent).cast("timestamp")) if sent in mails.columns else F.lit(None).cast("bigint")
    rows = mails.select(F.col(key).cast("bigint").alias("msg_id"), F.col(body).alias("body"), F.col(sender).alias("sender"), F.coalesce(at, F.lit((1 << 63) - 1)).alias("sent"))
    return spread(rows, "msg_id").mapInArrow(cut, MAILS)


def _matches(described: DataFrame) -> DataFrame:
    """(msg_id, variant, found): for each mail the keys that other mails have too: place, how many mails, 1 if an earlier one of another sender came first, 2 if one of its own."""
    rows = described.select("msg_id", "variant", "sent", "who", F.explode("keys").alias("k")).select("msg_id", "variant", "sent", "who", "k.key", "k.place")
    counted = rows.filter("variant = 0").groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("sent", F.col("msg_id").alias("m"), F.col("who").alias("w"))).alias("top"), F.max("msg_id").alias("last"))
    counted = written(counted.filter(F.col("last") != F.col("top.m")).select("key", "n", F.col("top.sent").alias("sent0"), F.col("top.m").alias("msg0"), F.col("top.w").alias("who0")), "keys")
    # keys with more than a thousandth of all rows are fewer than a thousand, and are joined by broadcast: none of them meets in one task
    total = counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot, cold = F.broadcast(counted.filter(F.col("n") * HOT > total)), counted.filter(F.col("n") * HOT <= total)
    pairs = rows.join(hot, "key").unionByName(rows.join(hot.select("key"), "key", "left_anti").join(cold, "key"))
    earlier = (F.col("sent0") < F.col("sent")) | (F.col("sent0") == F.col("sent")) & (F.col("msg0") < F.col("msg_id"))
    flag = F.when(earlier, F.when(F.col("who0") != F.col("who"), 1).otherwise(2)).otherwise(0)
    return pairs.groupBy("msg_id", "variant").agg(F.collect_list(F.struct("place", "n", flag.cast("int").alias("flag"))).alias("found"))


def _features(b: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(features of all blocks of a batch of mails, the row of the mail of each block)."""
    own = np.frombuffer(b"".join(b.column("x").to_pylist()), np.float16).reshape(-1, OWN).astype(np.float32)
    n_blocks = np.array([len(v) // 4 for v in b.column("first").to_pylist()], np.int64)
    x = np.zeros((len(own), len(FEATURES)), np.float32)
    x[:, :OWN] = own
    base = np.cumsum(n_blocks) - n_blocks
    found = b.column("found").to_pylist()
    rows = [(base[i] + f["place"] // 2, f["place"] & 1, f["n"], f["flag"]) for i, some in enumerate(found) for f in some or ()]
    if rows:
        at, kind, n, flag = np.array(rows, np.int64).T
        np.maximum.at(x[:, OWN], at[kind == 1], np.log1p(n[kind == 1] - 1))
        s = kind == 0
        for col, w in ((OWN + 1, flag == 1), (OWN + 2, flag == 2)):
            np.add.at(x[:, col], at[s & w], 1)
        np.add.at(x[:, OWN + 3], at[s], np.log1p(n[s] - 1))
        x[:, OWN + 1 :] /= np.maximum(x[:, FEATURES.index("sentences")], 1)[:, None]
    return x, np.repeat(np.arange(len(n_blocks)), n_blocks)


def foreign_lines(mails: DataFrame, key: str = "msg_id", body: str = "text_body", sender: str = "message_from", sent: str = "sent_at", sample: int = SAMPLE_MAILS) -> DataFrame:
    """(msg_id, line_no) of every line, from 1, that the sender of the message did not newly write.

    Lines are split at LF; blank lines are never listed. Messages listed twice count once. Null and empty bodies have no lines. The
    trees are fitted on about ``sample`` mails; frequencies of patterns and sentences are counted over all messages. A mail
    without a date (or all, without that column) counts as the latest.
    """
    described, matches = _described_with_matches(mails, sample, key, body, sender, sent)
    trees = fit_trees(*_training(described, matches))
    shared = mails.sparkSession.sparkContext.broadcast(trees)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            x, row = _features(b)
            bad = np.flatnonzero(shared.value.margin(x) > 0)
            first, last = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.int32)[bad] for c in ("first", "last"))
            n = last - first + 1
            line = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column("msg_id").to_numpy()[row[bad]], n)), pa.array(line.astype(np.int32))], names=["msg_id", "line_no"])

    own = described.filter("variant = 0").select("msg_id", "first", "last", "x")
    return own.join(matches.filter("variant = 0").select("msg_id", "found"), "msg_id", "left").mapInArrow(tell, "msg_id bigint, line_no int")


def _described_with_matches(mails: DataFrame, sample: int, key: str, body: str, sender: str, sent: str) -> tuple[DataFrame, DataFrame]:
    share = min(1.0, sample / max(1, mails.count()))
    described = written(described_mails(mails, share, key, body, sender, sent).dropDuplicates(["msg_id", "variant"]), "mails")
    return described, written(_matches(described), "matches")


def _training(described: DataFrame, matches: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the blocks of the sample, in the same order in every run."""
    rows = described.filter("sampled").join(matches, ["msg_id", "variant"], "left").select("msg_id", "variant", "first", "x", "label", "found").toArrow().sort_by([("msg_id", "ascending"), ("variant", "ascending")])
    if not len(rows):
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0)
    x, row = _features(rows)
    y = np.frombuffer(b"".join(rows.column("label").to_pylist()), np.int8).copy()
    # a mail without any mark says nothing of text that others sent before: it may be history whose marks are gone
    whole = rows.column("variant").to_numpy()[row] == 0
    y[whole & (y == 0) & (x[:, FEATURES.index("marked_mail")] == 0) & (x[:, FEATURES.index("ancestor_overlap")] > 0.5)] = -1
    return x[y >= 0], y[y >= 0].astype(float)


def authored_text(mails: DataFrame, lines: DataFrame, key: str = "msg_id", body: str = "text_body") -> DataFrame:
    """(msg_id, authored) of every message with a body: what is left without ``lines``, trimmed, at most one blank line in a row."""
    gone = lines.groupBy(F.col("msg_id").alias("k")).agg(F.collect_set("line_no").alias("gone"))
    m = mails.filter(F.col(body).isNotNull()).select(F.col(key).alias("msg_id"), F.split(F.regexp_replace(F.col(body), "\r", ""), "\n", -1).alias("all")).dropDuplicates(["msg_id"])
    kept = F.filter(F.col("all"), lambda x, i: ~F.coalesce(F.array_contains("gone", i + 1), F.lit(False)))
    return m.join(gone, m["msg_id"] == gone["k"], "left").select("msg_id", F.regexp_replace(F.regexp_replace(F.array_join(kept, "\n"), r"\n\s*\n+", "\n\n"), r"\A\s+|\s+\z", "").alias("authored"))
