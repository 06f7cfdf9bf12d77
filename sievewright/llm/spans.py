"""Long exact spans shared between records.

A stretch of ``least`` characters contains, wherever it lies, at least one *anchor*: a window of ``WINDOW``
characters whose hash is the smallest among its neighbours, so that two equal stretches have the same anchors at the same
places. A first pass lists the anchors; a window that one part of the table alone has more than ``FEW`` times, in several
records, is known to repeat and is sent on once for its part, so that no hash is frequent among what is shuffled. The hashes
go to blocks by their value, as many blocks as there are anchors for, each counts its own in a count-min sketch of
cells in proportion, which can only overestimate, and groups what it estimates repeated exactly. No sketch is
held as a whole anywhere, so that it has no ceiling. The places found go back to their texts, and the second pass cuts the
characters around them: every stretch of ``least`` characters around an anchor lies within its *context*. Within a group of
few members the common extensions are compared directly; in a group of many (a passage pasted into many different texts)
equal contexts collapse to one class and every stretch around the anchor is hashed and grouped, which is exact as well and
spreads over all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.llm.arrowtext import code_points, slices
from sievewright.staging import written

#: Members of a group up to which they are compared with one another; beyond, stretches are hashed.
FEW = 48
#: Cells of a block's sketch per anchor in it, at least; two bits a cell, two rows.
CELLS = 4
#: Anchors that one block counts, about, and that one part of the table holds before it sends them on.
BLOCK, PART = 1 << 20, 1 << 20
#: Texts on which the dictionary that packs contexts is trained; it only saves shuffled bytes.
SAMPLE_TEXTS = 400
_rng = np.random.default_rng(20_240_229)
_BASE = np.uint64(int(_rng.integers(1 << 62)) * 2 + 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def sizes(least: int) -> tuple[int, int]:
    """(length of an anchor, windows in a neighbourhood) so that a stretch of ``least`` characters holds an anchor."""
    k = max(1, least * 2 // 5)
    return k, least - k + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


class _Powers:
    """Powers of the base and of its inverse, as far as they are needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            with np.errstate(over="ignore"):
                grow = lambda b: np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(n - 1, b, np.uint64))))
                self.up, self.down = grow(_BASE), grow(np.uint64(pow(int(_BASE), -1, 1 << 64)))
        return self.up, self.down


_powers = _Powers()


def window_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every window of ``k`` code points."""
    n = len(points)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _powers.to(n + 1)
    with np.errstate(over="ignore"):
        c = _mixed(points.astype(np.uint64) + np.uint64(1))
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(c * up[:n], out=total[1:])
        return _mixed((total[k:] - total[:-k]) * down[: n - k + 1])


def _sliding(x: np.ndarray, w: int, op: np.ufunc, fill: np.uint64) -> np.ndarray:
    """op over every window of ``w`` values (van Herk and Gil-Werman): two running passes over blocks of w."""
    n = len(x)
    m = -(-n // w) * w
    y = np.full(m, fill, np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    left = op.accumulate(y, axis=1).ravel()
    right = op.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(right[: n - w + 1], left[w - 1 : n])


def anchors(points: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the anchors of texts laid end to end; those of texts shorter than ``least`` are left out."""
    k, w = sizes(least)
    top = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = window_hashes(points, k)
    if len(h) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # windows across two texts never are anchors
    for i in range(1, k) if len(starts) > 2 else ():
        at = starts[1:-1] - i
        h[at[(at >= 0) & (at < len(h))]] = top
    low = _sliding(h, w, np.minimum, top)
    best = np.zeros(len(h), np.uint64)
    padded = np.concatenate((np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)))
    best = _sliding(padded, w, np.maximum, np.uint64(0))[: len(h)]
    at = np.flatnonzero((h == best) & (h != top))
    row = np.searchsorted(starts, at, side="right") - 1
    fits = (starts[row + 1] - starts[row] >= least) & (at + k <= starts[row + 1])
    at = at[fits]
    return at, h[at]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, code points, starts) in slices of bounded size; rows without id or text are left out."""
    for whole in batches:
        whole = whole.filter(pa.compute.and_(whole.column(0).is_valid(), whole.column(1).is_valid()))
        for i, j in slices(pa.compute.binary_length(whole.column(1)).to_numpy(zero_copy_only=False)) if len(whole) else ():
            b = whole.slice(i, j - i)
            yield (b.column(0).to_numpy(), *code_points(b.column(1)))


class Sketch:
    """A count-min sketch with two rows of two-bit counters that stop at 2: enough to tell once from more than once."""

    def __init__(self, bits: int, cells: np.ndarray | None = None) -> None:
        self.bits = bits
        self.cells = np.zeros((2, 1 << bits), np.uint8) if cells is None else cells

    def _at(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.uint64(64 - self.bits)
        with np.errstate(over="ignore"):
            # anchors are small among hashes, so that their first bits alone would not spread
            return (_mixed(h) >> s).astype(np.int64), (_mixed(h * _BASE) >> s).astype(np.int64)

    def add(self, h: np.ndarray) -> None:
        for row, at in zip(self.cells, self._at(h)):
            cell, n = np.unique(at, return_counts=True)
            row[cell] = np.minimum(row[cell] + np.minimum(n, 2), 2)

    def packed(self) -> np.ndarray:
        c = self.cells.reshape(-1, 4)
        return c[:, 0] | c[:, 1] << 2 | c[:, 2] << 4 | c[:, 3] << 6


def repeated(packed: np.ndarray, bits: int, h: np.ndarray) -> np.ndarray:
    """If a hash was counted more than once in a packed sketch, or may have been; reads it as it is, without unpacking."""
    a, b = Sketch(bits, packed)._at(h)
    b = b + (1 << bits)
    many = lambda at: (packed[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3) > 1
    return many(a) & many(b)


def _listed(least: int):  # noqa: ANN202
    """The map that lists anchors: (h, doc_id, pos, crowd).

    ``crowd`` marks members of a window that their part has more than ``FEW`` times in several records; such a window is
    also listed once without a record, for those who have it elsewhere.
    """

    def part(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        h, doc, pos = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, np.int64)
        n = np.diff(np.r_[first, len(h)])
        by = doc[order]
        hot = (n > FEW) & (np.minimum.reduceat(by, first) != np.maximum.reduceat(by, first)) if len(h) else np.zeros(0, bool)
        crowd = np.zeros(len(h), bool)
        crowd[order] = np.repeat(hot, n)
        extra = h[order][first[hot]]
        none = np.r_[np.zeros(len(h), bool), np.ones(len(extra), bool)]
        zero = np.zeros(len(extra), np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.r_[h, extra].view(np.int64)), pa.array(np.r_[doc, zero], mask=none), pa.array(np.r_[pos, zero].astype(np.int32), mask=none), pa.array(np.r_[crowd, ~zero.astype(bool)])],
            names=["h", "doc_id", "pos", "crowd"],
        )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for ids, points, starts in _texts(batches):
            at, h = anchors(points, starts, least)
            row = np.searchsorted(starts, at, side="right") - 1
            held.append((h, ids[row], at - starts[row]))
            n += len(h)
            if n >= PART:
                yield part(held)
                held, n = [], 0
        if n:
            yield part(held)

    return rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One block of the sketch: (doc_id, place) of its anchors that more than one record has; place is 2 * pos + 1 in a group of more than ``FEW``."""
    whole = pa.Table.from_batches(list(batches), pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())]))
    h = whole["h"].to_numpy().view(np.uint64)
    alone = whole["doc_id"].is_null().to_numpy()
    doc, pos = (whole[c].fill_null(0).to_numpy() for c in ("doc_id", "pos"))
    sketch = Sketch(max(10, (CELLS * len(h)).bit_length()))
    sketch.add(np.r_[h, h[alone]])
    some = repeated(sketch.packed(), sketch.bits, h)
    h, alone, doc, pos = (x[some] for x in (h, alone, doc, pos))
    if not len(h):
        return
    order = np.argsort(h, kind="stable")
    h, alone, doc, pos = (x[order] for x in (h, alone, doc, pos))
    first = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    n = np.diff(np.r_[first, len(h)])
    crowd = np.maximum.reduceat(alone, first)
    shared = crowd | (np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first))
    out = np.repeat(shared, n) & ~alone
    place = 2 * pos.astype(np.int64) + np.repeat(crowd | (n > FEW), n)
    yield pa.RecordBatch.from_arrays([pa.array(doc[out]), pa.array(place[out])], names=["doc_id", "place"])


def repeated_places(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, places): where each record has anchors that another record has as well, by a count-min sketch in blocks."""
    found = written(docs.mapInArrow(_listed(least), "h bigint, doc_id bigint, pos int, crowd boolean"), "anchors")
    n, cores = found.count(), docs.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n // BLOCK), min(cores, -(-n // (BLOCK >> 4))))
    tested = found.filter("doc_id IS NULL OR NOT crowd").select("h", "doc_id", "pos").repartition(blocks, "h").mapInArrow(_counted, "doc_id bigint, place bigint")
    known = found.filter("doc_id IS NOT NULL AND crowd").select("doc_id", (F.col("pos").cast("bigint") * 2 + 1).alias("place"))
    return tested.unionByName(known).groupBy("doc_id").agg(F.collect_set("place").alias("places"))


def _dictionary(docs: DataFrame) -> bytes:
    """A zstandard dictionary from a bounded sample, beginnings of a few texts; empty if there is too little to train on."""
    texts = [r["text"].encode("utf-8", "surrogatepass") for r in docs.filter("text IS NOT NULL AND text <> ''").select(F.substring("text", 1, 20_000).alias("text")).limit(SAMPLE_TEXTS).collect()]
    try:
        return zstandard.train_dictionary(64 << 10, [t[i : i + 400] for t in texts for i in range(0, len(t), 400)]).as_bytes()
    except zstandard.ZstdError:
        return b""


def _packer(dictionary: bytes) -> zstandard.ZstdCompressor:
    z = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    if z:
        z.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=z, write_checksum=False, write_dict_id=False) if z else zstandard.ZstdCompressor(level=3)


def _unpacker(dictionary: bytes):  # noqa: ANN202
    """Gives (left context from the anchor outwards, right context)."""
    d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()

    def unpack(packed: bytes, n_left: int) -> tuple[str, str]:
        text = d.decompress(packed).decode("utf-8", "surrogatepass")
        return text[:n_left][::-1], text[n_left:]

    return unpack


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _extents(classes: list[dict], least: int, k: int) -> list[tuple[int, int, int] | None]:
    """Per class, how far shared stretches reach left and right of the anchor; None if none does.

    Two classes share the common extension to both sides if it is long enough; a class of several
    records shares its whole context. Classes of one and the same record don't count for each other.
    """
    n = len(classes)
    left, right = [0] * n, [0] * n
    for i, c in enumerate(classes):
        if c["low"] != c["high"] and len(c["left"]) + k + len(c["right"]) >= least:
            left[i], right[i] = len(c["left"]), len(c["right"])
    for i in range(n):
        x = classes[i]
        for j in range(i + 1, n):
            y = classes[j]
            if x["low"] == x["high"] == y["low"] == y["high"]:
                continue
            a, b = _common(x["left"], y["left"]), _common(x["right"], y["right"])
            if a + k + b >= least:
                left[i], left[j] = max(left[i], a), max(left[j], a)
                right[i], right[j] = max(right[i], b), max(right[j], b)
    return [(a, b) if a + k + b >= least else None for a, b in zip(left, right)]


def shared_spans(documents: DataFrame, least: int = 300, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, span_start, span_end): maximal runs of characters in stretches of ``least`` or more that another record has too.

    Code points exactly as stored, from 0, end exclusive. Records are told apart by their id: rows of one id
    share nothing with each other. Null, empty and shorter texts have no spans; whole equal texts are one span each.
    """
    k, w = sizes(least)
    reach = least - k
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).filter(F.length("text") >= least)
    places = repeated_places(docs, least)
    dictionary = _dictionary(docs)

    def around_repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = _packer(dictionary).compress
        for whole in batches:
            for i, j in slices(pa.compute.binary_length(whole.column(1)).to_numpy(zero_copy_only=False)):
                b = whole.slice(i, j - i)
                points, starts = code_points(b.column(1))
                place = pa.compute.list_flatten(b.column(2)).to_numpy()
                row = np.repeat(np.arange(len(b)), pa.compute.list_value_length(b.column(2)).to_numpy(zero_copy_only=False))
                at = starts[row] + (place >> 1)
                # rows of one id may have different texts: places of the others are windows too, unless they lie outside
                inside = at + k <= starts[row + 1]
                at, row, many = at[inside], row[inside], (place[inside] & 1).astype(bool)
                a, z = np.maximum(at - reach, starts[row]), np.minimum(at + k + reach, starts[row + 1])
                raw = points.astype("<u4").tobytes()
                cut = lambda i, j: raw[4 * i : 4 * j].decode("utf-32-le", "surrogatepass")  # noqa: B023, E731
                around_text = [pack((cut(i, p) + cut(p + k, j)).encode("utf-8", "surrogatepass")) for i, p, j in zip(a.tolist(), at.tolist(), z.tolist())]
                group = [xxhash.xxh3_128_digest(raw[4 * i : 4 * (i + k)]) for i in at.tolist()]
                around = [xxhash.xxh3_64_intdigest(raw[4 * i : 4 * j]) - (1 << 63) ^ (p - i) for i, j, p in zip(a.tolist(), z.tolist(), at.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(group, pa.binary()), pa.array(around, pa.int64()), b.column(0).take(pa.array(row)), pa.array((at - starts[row]).astype(np.int32)), pa.array((at - a).astype(np.int32)), pa.array(around_text, pa.binary()), pa.array(many)],
                    names=["grp", "ctx", "doc_id", "pos", "n_left", "around", "many"],
                )

    at_places = docs.join(places.hint("shuffle_hash"), "doc_id")
    windows = written(at_places.mapInArrow(around_repeated, "grp binary, ctx bigint, doc_id bigint, pos int, n_left int, around binary, many boolean"), "windows")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpacker(dictionary)
        for b in batches:
            out: tuple[list, ...] = ([], [], [])
            for members in b.column(0).to_pylist():
                classes: dict[int, dict] = {}
                for m in members:
                    c = classes.get(m["ctx"])
                    if c is None:
                        left, right = unpack(m["around"], m["n_left"])
                        classes[m["ctx"]] = {"low": m["doc_id"], "high": m["doc_id"], "left": left, "right": right}
                    else:
                        c["low"], c["high"] = min(c["low"], m["doc_id"]), max(c["high"], m["doc_id"])
                reached = dict(zip(classes, _extents(list(classes.values()), least, k)))
                for m in members:
                    if e := reached[m["ctx"]]:
                        for col, v in zip(out, (m["doc_id"], m["pos"] - e[0], m["pos"] + k + e[1])):
                            col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.int32())], names=["doc_id", "s", "e"])

    # groups of FEW members at most, so each list is short however frequent a passage is
    few = windows.filter(~F.col("many")).groupBy("grp").agg(F.collect_set(F.struct("ctx", "doc_id", "pos", "n_left", "around")).alias("members")).select("members").mapInArrow(compare, "doc_id bigint, s int, e int")
    crowded = windows.filter("many")
    classes = crowded.groupBy("grp", "ctx").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("n_left").alias("n_left"), F.first("around").alias("around"))
    extents = _extents_of_many(classes, least, k, dictionary)
    hits = crowded.select("grp", "ctx", "doc_id", "pos").join(extents, ["grp", "ctx"]).select("doc_id", (F.col("pos") - F.col("l")).alias("s"), (F.col("pos") + k + F.col("r")).alias("e"))
    return _runs(few.unionByName(hits))


def _extents_of_many(classes: DataFrame, least: int, k: int, dictionary: bytes) -> DataFrame:
    """The same as :func:`_extents` for groups of many classes: hash every stretch around the anchor, group, join back."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpacker(dictionary)
        for b in batches:
            for grp, ctx, low, high, n_left, around in zip(*(b.column(i).to_pylist() for i in range(6))):
                left, right = unpack(around, n_left)
                body = left[::-1] + "\x00" * k + right
                n = len(body) - least + 1
                if n < 1:
                    continue
                points = np.frombuffer(body.encode("utf-32-le", "surrogatepass"), np.uint32)
                # two hashes with different multipliers make 128 bits
                h1 = window_hashes(points, least).view(np.int64)
                h2 = window_hashes(points ^ np.uint32(0x5BD1E995), least).view(np.int64)
                # a stretch that starts ``a`` characters before the anchor reaches this far to the right
                a = len(left) - np.arange(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([grp] * n, pa.binary()), pa.array(np.full(n, ctx)), pa.array(np.full(n, low)), pa.array(np.full(n, high)), pa.array(a.astype(np.int32)), pa.array(h1), pa.array(h2)],
                    names=["grp", "ctx", "low", "high", "a", "h1", "h2"],
                )

    every = classes.select("grp", "ctx", "low", "high", "n_left", "around").mapInArrow(stretches, "grp binary, ctx bigint, low bigint, high bigint, a int, h1 bigint, h2 bigint")
    key = ["grp", "a", "h1", "h2"]
    shared = every.groupBy(*key).agg(F.min("low").alias("low"), F.max("high").alias("high")).filter("low <> high").select(*key)
    return every.join(shared, key, "left_semi").groupBy("grp", "ctx").agg(F.max("a").alias("l"), (F.lit(least - k) - F.min("a")).alias("r"))


def _runs(hits: DataFrame) -> DataFrame:
    """Unite intervals of a record that overlap or touch."""
    order = Window.partitionBy("doc_id").orderBy("s", "e")
    until = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    return (
        hits.groupBy("doc_id", "s").agg(F.max("e").alias("e"))
        .withColumn("fresh", F.when(until >= F.col("s"), 0).otherwise(1))
        .withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc_id", "run")
        .agg(F.min("s").cast("bigint").alias("span_start"), F.max("e").cast("bigint").alias("span_end"))
        .select("doc_id", "span_start", "span_end")
    )


def shared_shares(documents: DataFrame, spans: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per record, how many of its characters lie in shared spans, and which part of it that is; 0 for the others."""
    total = spans.groupBy(F.col("doc_id").alias("span_id")).agg(F.sum(F.col("span_end") - F.col("span_start")).alias("n"))
    d = documents.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("bigint").alias("n_chars"))
    shared = F.coalesce("n", F.lit(0)).cast("bigint")
    return d.join(total, d["doc_id"] == total["span_id"], "left").select("doc_id", "n_chars", shared.alias("shared_chars"), F.when(F.col("n_chars") > 0, F.round(shared / F.col("n_chars"), 6)).otherwise(F.lit(0.0)).alias("share"))
