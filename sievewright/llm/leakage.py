"""Evaluation texts inside training text, by suffix arrays of the training text.

Each batch of training texts is a shard with a suffix array of its words. Every suffix of every evaluation item
is looked up in it by binary search, and each place found is followed for as long as the words agree, which gives the
longest verbatim matches and where they are. A suffix can only match if its words occur in the evaluation texts, so
the array leaves out, without loss, the runs of fewer than ``least`` consecutive words of that vocabulary.
The items are a stated query set: they go to the executors in blocks of bounded size, each block against all rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
#: Bytes of evaluation text that one block may hold.
BLOCK_BYTES = 16 << 20
#: Words of training text in one suffix array.
SHARD_WORDS = 2_000_000
SCHEMA = "doc_id bigint, item_id bigint, doc_word bigint, item_word bigint, n_words bigint"


def words(text: str) -> list[str]:
    """Maximal runs of letters or digits, without regard to case."""
    return WORD.findall(text.casefold())


@dataclass
class ItemBlock:
    """Items of one block: word ids laid end to end with 0 between, and each position's item and place in it."""

    vocabulary: dict[str, int]
    ids: np.ndarray
    item: np.ndarray
    place: np.ndarray
    suffixes: np.ndarray  # positions that at least ``least`` words follow
    keys: np.ndarray
    least: int


def _keys(ids: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """The first ``least`` words of suffixes as fixed-width bytes that sort as the suffixes do."""
    if not len(at):
        return np.zeros(0, f"S{4 * least}")
    rows = ids[at[:, None] + np.arange(least)].astype(">u4")
    return np.ascontiguousarray(rows).view(f"S{4 * least}").ravel()


def item_block(items: list[tuple[int, str]], least: int) -> ItemBlock:
    """Prepare one block of (item id, text)."""
    vocabulary: dict[str, int] = {}
    ids, item, place, suffixes = [0], [-1], [-1], []
    for i, text in items:
        w = words(text or "")
        begin = len(ids)
        # ids keep every byte but the last non-zero only where needed: they start at 1, and 0 never lies inside a key
        ids += [vocabulary.setdefault(x, len(vocabulary) + 1) for x in w] + [0]
        item += [i] * len(w) + [-1]
        place += [*range(len(w)), -1]
        suffixes += range(begin, begin + len(w) - least + 1)
    a = np.array(ids, np.uint32)
    s = np.array(suffixes, np.int64)
    return ItemBlock(vocabulary, a, np.array(item, np.int64), np.array(place, np.int64), s, _keys(a, s, least), least)


def suffix_array(ids: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in the order of their suffixes' first ``least`` words, those words as sorted keys); only suffixes without a 0 in them."""
    if len(ids) < least:
        return np.zeros(0, np.int64), np.zeros(0, f"S{4 * least}")
    stops = np.concatenate(([0], np.cumsum(ids == 0)))
    at = np.flatnonzero(stops[least:] == stops[:-least])
    keys = _keys(ids, at, least)
    order = np.argsort(keys, kind="stable")
    return at[order], keys[order]


def _matches(block: ItemBlock, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(positions in the shard, positions in the block, words in common) of each maximal verbatim match."""
    order, keys = suffix_array(ids, block.least)
    low, high = np.searchsorted(keys, block.keys, "left"), np.searchsorted(keys, block.keys, "right")
    n = high - low
    if not n.sum():
        z = np.zeros(0, np.int64)
        return z, z, z
    here = np.repeat(block.suffixes, n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    there = order[np.repeat(low, n) + inner]
    # a match that the words before carry on is part of a longer one
    begin = (ids[there - 1] != block.ids[here - 1]) | (ids[there - 1] == 0)
    here, there = here[begin], there[begin]
    length = np.full(len(here), block.least, np.int64)
    grow = np.arange(len(here))
    while len(grow):
        a, b = ids[there[grow] + length[grow]], block.ids[here[grow] + length[grow]]
        grow = grow[(a == b) & (a != 0)]
        length[grow] += 1
    return there, here, length


def leaked_passages(documents: DataFrame, items: DataFrame, least: int = 13, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Every maximal run of ``least`` or more words that a document shares with an item.

    Columns: doc_id, item_id, doc_word and item_word (where the run starts, in words from 0), n_words. Texts that are
    null, empty or shorter than ``least`` words share nothing. Repeated documents each count; repeated items with one id
    give one row. A map over the documents: nothing is shuffled, whatever share of them holds the same passage.
    """
    spark = documents.sparkSession
    q = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL").distinct()
    total = q.agg(F.sum(F.octet_length("t")).alias("n")).first()["n"] or 0
    n_blocks = max(1, -(-int(total) // BLOCK_BYTES))
    docs = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for k in range(n_blocks):
        part = q if n_blocks == 1 else q.filter(F.pmod(F.xxhash64("t"), F.lit(n_blocks)) == k)
        block = item_block([(r["i"], r["t"]) for r in part.sort("i", "t").collect()], least)
        shared = spark.sparkContext.broadcast(block)
        found = docs.mapInArrow(_searcher(shared), SCHEMA)
        out = found if out is None else out.unionByName(found)
    return out


def _searcher(shared):  # noqa: ANN001, ANN202
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: ItemBlock = shared.value
        get, least = block.vocabulary.get, block.least
        schema = pa.schema([(n.split()[0], pa.int64()) for n in SCHEMA.split(", ")])

        def flush(runs: list[int], doc: list[int], place: list[int]) -> pa.RecordBatch:
            ids, d, p = np.array([*runs, 0], np.uint32), np.array([*doc, -1], np.int64), np.array([*place, -1], np.int64)
            there, here, n = _matches(block, ids)
            rows = np.unique(np.stack([d[there], block.item[here], p[there], block.place[here], n], axis=1), axis=0) if len(there) else np.zeros((0, 5), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(rows[:, i])) for i in range(5)], schema=schema)

        runs, doc, place = [0], [-1], [-1]
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if t is None or i is None:
                    continue
                w = list(map(get, words(t)))
                start, n = 0, len(w)
                # runs of the items' vocabulary; step by ``least`` to skip what holds none
                while start + least <= n:
                    end = start + least - 1
                    while end >= start and w[end] is not None:
                        end -= 1
                    if end >= start:
                        start = end + 1
                        continue
                    stop = start + least
                    while stop < n and w[stop] is not None:
                        stop += 1
                    runs += w[start:stop] + [0]
                    doc += [i] * (stop - start) + [-1]
                    place += [*range(start, stop), -1]
                    start = stop + 1
                if len(runs) > SHARD_WORDS:
                    yield flush(runs, doc, place)
                    runs, doc, place = [0], [-1], [-1]
        yield flush(runs, doc, place)

    return search


def leaks(passages: DataFrame) -> DataFrame:
    """One row per document and item: the longest match, the number of matches."""
    return passages.groupBy("doc_id", "item_id").agg(F.max("n_words").alias("longest"), F.count("*").alias("n_passages"))


def without_leaks(documents: DataFrame, passages: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents in which no passage was found."""
    bad = passages.select(F.col("doc_id").alias("leaked_id")).distinct()
    return documents.join(bad, documents[doc_id] == bad["leaked_id"], "left_anti")
