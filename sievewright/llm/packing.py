"""Filling containers of fixed capacities with texts, sized in tokens.

Only a histogram of sizes decides how containers are filled; it has no more entries than the capacity, however many texts
there are, so it is planned on the driver. Sizes are routed to tiers of context windows (over 1/2, 1/4, 1/8 of the capacity,
and the rest). Each tier is packed by itself, longest window first: its largest size opens a container, and sizes of
the tier fill it as long as one fits. The gap that is left is filled from the shorter tiers, the last of it by the pair that fits
best. A plan is a list of patterns with how often each is used. Texts are then numbered within their size in the
order of a hash, in parts so that a size that very many texts share is spread, and the number alone says which container and place
a text gets. Containers of a tier are dealt to step groups back and forth by fill, so that the groups of a tier carry
nearly the same number of tokens. Containers that one piece of an oversized text fills are the fullest of the first tier and
are dealt before all others of it.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievewright.staging import written

#: Where the public vocabulary lies that sizes are counted with; a parameter of :func:`token_sizes`.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of one size that one task numbers, about; the numbers are the same whatever it is.
PART_ROWS = 200_000
#: Tiers, each for texts up to half the size of the one before.
TIERS = 4
#: Larger partners that are tried for the last gap of a container.
PARTNERS = 24
_SHIFT = 40  # bits for the number of a text within its size


class _Vocabulary:
    """The bytes of a vocabulary file; tasks that follow one another in a Python worker share the encoder made of them."""

    def __init__(self, raw: bytes) -> None:
        self.raw, self.encode = raw, None

    def encoder(self) -> Callable[[str], list[int]]:
        if self.encode is None:
            import tiktoken

            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.raw.splitlines())}
            self.encode = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return self.encode


def token_sizes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every text, whole; null and empty texts have 0 tokens.

    The vocabulary is read where the driver runs and sent along; executors need no file.
    """
    with open(vocabulary, "rb") as f:
        shared = documents.sparkSession.sparkContext.broadcast(_Vocabulary(f.read()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = shared.value.encoder()
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, "doc_id bigint, n_tokens bigint")


@dataclass
class Plan:
    """Which container the r-th text of a size goes to; arrays run over uses of a size in a pattern."""

    key: np.ndarray  # size << _SHIFT | first number within the size
    copies: np.ndarray  # texts of the size in one container of the pattern
    base: np.ndarray  # first container of the pattern
    slot: np.ndarray  # first place of the size in a container
    offset: np.ndarray  # tokens before that place
    position: np.ndarray  # place of the pattern's first container in its tier, by fill
    tier: np.ndarray
    steps: np.ndarray  # step groups in the tier
    step_base: np.ndarray
    n_containers: int = 0  # without the full ones, which are numbered after these
    full_steps: int = 1  # step groups in the first tier, over which the full containers are dealt from its place 0 on
    fills: list[tuple[int, int]] | None = None  # (tokens in a container, containers)


def route(size: int, capacity: int) -> int:
    """The tier of a size: 0 for more than half the capacity, 1 for more than a quarter, and so on; the last has all the rest."""
    return next((t for t in range(TIERS - 1) if size << t + 1 > capacity), TIERS - 1)


class _Stock:
    """How many texts of each size are left, with the next smaller size that is not used up in nearly constant time."""

    def __init__(self, histogram: dict[int, int], capacity: int) -> None:
        self.counts = [0] * (capacity + 1)
        for s, n in histogram.items():
            self.counts[s] = n
        self.below = [s if s == 0 or n else s - 1 for s, n in enumerate(self.counts)]

    def at_most(self, size: int) -> int:
        """The largest size up to ``size`` that is left; 0 if there is none."""
        below, s = self.below, size
        while below[s] != s:
            below[s] = below[below[s]]
            s = below[s]
        return s

    def free(self, size: int, inside: dict[int, int]) -> int:
        """As :meth:`at_most`, without what a container already takes."""
        s = self.at_most(max(size, 0))
        while s and self.counts[s] <= inside.get(s, 0):
            s = self.at_most(s - 1)
        return s

    def take(self, inside: dict[int, int]) -> int:
        """Use up a pattern as often as it goes; returns how often."""
        many = min(self.counts[s] // k for s, k in inside.items())
        for s, k in inside.items():
            self.counts[s] -= k * many
            if not self.counts[s]:
                self.below[s] = s - 1
        return many

    def pair(self, gap: int, separator: int, inside: dict[int, int]) -> tuple[int, int]:
        """Two sizes, larger first, that fill ``gap`` best, or one with 0."""
        best = (a := self.free(gap, inside), 0)
        most = a
        for _ in range(PARTNERS):
            if not a or most == gap or 2 * a + separator <= most:
                break
            rest = gap - separator - a
            b = self.free(min(rest, a), inside) if rest > 0 else 0
            if b == a and self.counts[a] < inside.get(a, 0) + 2:
                b = self.free(a - 1, inside)
            if b and a + b + separator > most:
                most, best = a + b + separator, (a, b)
            a = self.free(a - 1, inside)
        return best


def _pack_tier(stock: _Stock, low: int, high: int, capacity: int, separator: int) -> Iterator[tuple[dict[int, int], int]]:
    """(sizes in a container, number of such containers) until the sizes over ``low`` up to ``high`` are used up."""
    while (top := stock.at_most(high)) > low:
        inside = {top: 1}
        gap = capacity - top - separator
        # the tier's own sizes first, then those of shorter tiers
        for floor in (low, 0):
            while gap > 0 and (s := stock.free(min(gap, high), inside)) > floor:
                if gap - s <= s + separator:
                    # the last or the last but one
                    a, b = stock.pair(gap, separator, inside)
                    s = a
                inside[s] = inside.get(s, 0) + 1
                gap -= s + separator
        yield inside, stock.take(inside)


def _step(position: np.ndarray, steps: np.ndarray | int) -> np.ndarray:
    """The step group, counted within the tier, of a container by its place there."""
    lap, at = position // steps, position % steps
    return np.where(lap % 2 == 0, at, steps - 1 - at)


def plan(histogram: dict[int, int], capacity: int, separator: int, group: int = 8, full: int = 0) -> Plan:
    """Pack a histogram {size: how many}, sizes from 1 to ``capacity``; each pattern uses up a size, so there are few.

    ``full`` containers besides, each filled by one piece of an oversized text, take the first places of the first tier.
    """
    stock = _Stock({s: n for s, n in histogram.items() if n > 0}, capacity)
    used: dict[int, int] = {}
    patterns: list[tuple[list[tuple[int, int]], int, int]] = []
    for tier in range(TIERS):
        high, low = capacity >> tier, capacity >> tier + 1 if tier < TIERS - 1 else 0
        for inside, many in _pack_tier(stock, low, high, capacity, separator):
            fill = sum(s * k for s, k in inside.items()) + separator * (sum(inside.values()) - 1)
            patterns.append((sorted(inside.items(), reverse=True), many, fill))
    # step groups: per tier, containers by fill, dealt back and forth
    place: dict[int, tuple[int, int, int]] = {}
    step_base, full_steps = 0, 1
    for tier in range(TIERS):
        own = sorted((i for i, p in enumerate(patterns) if route(p[0][0][0], capacity) == tier), key=lambda i: -patterns[i][2])
        at = full if tier == 0 else 0
        n = sum(patterns[i][1] for i in own) + at
        steps = max(1, -(-n // group))
        if tier == 0:
            full_steps = steps
        for i in own:
            place[i] = (at, steps, step_base)
            at += patterns[i][1]
        step_base += steps if n else 0
    rows, base = [], 0
    for i, (inside_list, many, _) in enumerate(patterns):
        slot = offset = 0
        at, steps, first_step = place[i]
        for s, k in inside_list:
            rows.append((s << _SHIFT | used.get(s, 0), k, base, slot, offset, at, route(inside_list[0][0], capacity), steps, first_step))
            used[s] = used.get(s, 0) + k * many
            slot += k
            offset += k * (s + separator)
        base += many
    a = np.array(sorted(rows), np.int64).reshape(-1, 9)
    return Plan(*(a[:, j].copy() for j in range(9)), n_containers=base, full_steps=full_steps, fills=[(f, m) for _, m, f in patterns])


def pack(documents: DataFrame, containers: DataFrame, group: int = 8, vocabulary: str = VOCABULARY, sizes: DataFrame | None = None) -> DataFrame:
    """The place of every text in containers of every capacity of ``containers``.

    One row per piece: container_id (the capacity's id), container_no, slot and offset (tokens before it in the
    container), doc_id, piece_no, token_start and n_tokens (within the text), tier, step. A text is cut only if
    it alone exceeds the capacity: into pieces of exactly the capacity, which fill containers of their own, and a rest that is
    packed like a text. A text without tokens takes no room: one row with null container_no. ``separator_tokens`` are
    lost between two items of a container. ``containers`` is a list of capacities: a few rows, read to the driver.
    """
    spark = documents.sparkSession
    sizes = written(token_sizes(documents, vocabulary=vocabulary) if sizes is None else sizes, "sizes")
    specs = [(r["container_id"], r["capacity_tokens"], r["separator_tokens"] or 0) for r in containers.dropDuplicates(["container_id"]).sort("container_id").collect() if r["capacity_tokens"] and r["capacity_tokens"] > 0]
    if not specs:
        return spark.createDataFrame([], "container_id int, container_no bigint, slot int, offset bigint, doc_id bigint, piece_no bigint, token_start bigint, n_tokens bigint, tier int, step bigint")
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("int").alias("container_id"), F.lit(c).cast("bigint").alias("capacity")) for i, c, _ in specs])).alias("c")
    cut = F.when(F.col("n_tokens") > F.col("c.capacity"), F.floor(F.col("n_tokens") / F.col("c.capacity"))).otherwise(F.lit(0)).cast("bigint")
    items = sizes.select("doc_id", "n_tokens", each).select("c.container_id", "c.capacity", "doc_id", "n_tokens", cut.alias("whole")).withColumn("rest", F.col("n_tokens") - F.col("whole") * F.col("capacity"))
    table = items.groupBy("container_id", "rest").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")).collect()  # one row per capacity and size up to it
    plans, whole_base = {}, {}
    for i, c, sep in specs:
        own = {r["rest"]: (r["n"], r["whole"]) for r in table if r["container_id"] == i}
        plans[i] = plan({s: n for s, (n, _) in own.items() if s > 0}, c, sep, group, sum(whole for _, whole in own.values()))
        at = plans[i].n_containers
        for s in sorted(own):
            whole_base[i, s] = at
            at += own[s][1]
    n_parts = max(1, -(-max((r["n"] for r in table), default=1) // PART_ROWS))
    # parts are ranges of the hash, so that numbers follow its order however many parts there are
    hashed = items.withColumn("h", F.xxhash64("doc_id"))
    salted = hashed.withColumn("part", F.floor((F.shiftright("h", 44) + (1 << 19)) * n_parts / (1 << 20)).cast("int"))
    key = ["container_id", "rest"]
    within = Window.partitionBy(*key, "part").orderBy("h", "doc_id")
    numbered = salted.withColumn("r", F.row_number().over(within).cast("bigint") - 1).withColumn("w", F.sum("whole").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole"))
    if n_parts > 1:
        before = Window.partitionBy(*key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        parts = salted.groupBy(*key, "part").agg(F.count("*").alias("pn"), F.sum("whole").alias("pw"))
        parts = parts.select(*key, "part", F.coalesce(F.sum("pn").over(before), F.lit(0)).alias("r0"), F.coalesce(F.sum("pw").over(before), F.lit(0)).alias("w0"))
        numbered = numbered.join(parts, [*key, "part"]).withColumn("r", F.col("r") + F.col("r0")).withColumn("w", F.col("w") + F.col("w0"))
    shared = spark.sparkContext.broadcast((plans, whole_base))  # bounded by the capacities, as the histogram is
    names = ["container_id", "container_no", "slot", "offset", "doc_id", "piece_no", "token_start", "n_tokens", "tier", "step"]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plans, whole_base = shared.value
        for b in batches:
            ids = b.column(0).to_numpy()
            for i in np.unique(ids):
                own = b.filter(pa.array(ids == i))
                p, doc = plans[int(i)], own.column(2)
                capacity, n, whole, rest, r, w = (own.column(c).to_numpy() for c in (1, 3, 4, 5, 6, 7))
                out = []
                if (some := rest > 0).any():
                    q = np.searchsorted(p.key, rest[some] << _SHIFT | r[some], side="right") - 1
                    nth = r[some] - (p.key[q] & ((1 << _SHIFT) - 1))
                    turn, inner = nth // p.copies[q], nth % p.copies[q]
                    step = p.step_base[q] + _step(p.position[q] + turn, p.steps[q])
                    sep = int(separators[int(i)])
                    cols = [np.full(some.sum(), i), p.base[q] + turn, p.slot[q] + inner, p.offset[q] + inner * (rest[some] + sep), None, whole[some], whole[some] * capacity[some], rest[some], p.tier[q], step]
                    out.append((cols, doc.filter(pa.array(some))))
                if (cutup := whole > 0).any():
                    k = whole[cutup]
                    piece = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    first = np.array([whole_base[int(i), int(s)] for s in rest[cutup]]) + w[cutup]
                    size = np.repeat(capacity[cutup], k)
                    zero = np.zeros(len(piece), np.int64)
                    src = np.repeat(np.flatnonzero(cutup), k)
                    no = np.repeat(first, k) + piece
                    out.append(([np.full(len(piece), i), no, zero, zero, None, piece, piece * size, size, zero, _step(no - p.n_containers, p.full_steps)], doc.take(pa.array(src))))
                if (empty := n == 0).any():
                    zero = np.zeros(empty.sum(), np.int64)
                    out.append(([np.full(empty.sum(), i), None, None, None, None, zero, zero, zero, None, None], doc.filter(pa.array(empty))))
                for cols, d in out:
                    yield pa.RecordBatch.from_arrays([d if name == "doc_id" else pa.nulls(len(d), t) if c is None else pa.array(c).cast(t) for name, t, c in zip(names, kinds, cols)], names=names)

    separators = {i: sep for i, _, sep in specs}
    schema = "container_id int, container_no bigint, slot int, offset bigint, doc_id bigint, piece_no bigint, token_start bigint, n_tokens bigint, tier int, step bigint"
    return numbered.select("container_id", "capacity", "doc_id", "n_tokens", "whole", "rest", "r", "w").mapInArrow(place, schema)


def fill(assignment: DataFrame, containers: DataFrame) -> DataFrame:
    """Per capacity: containers used, tokens in them, and the part of the capacity that holds text."""
    used = assignment.filter("container_no IS NOT NULL").groupBy("container_id").agg(F.max("container_no").alias("last"), F.sum("n_tokens").alias("tokens"))
    return used.join(F.broadcast(containers.select("container_id", "capacity_tokens")), "container_id").select("container_id", (F.col("last") + 1).alias("n_containers"), "tokens", F.round(F.col("tokens") / ((F.col("last") + 1) * F.col("capacity_tokens")), 6).alias("filled"))
