"""Screening by models: a classifier over token windows, and a guard model behind an HTTP endpoint.

Models and their servers are parameters. Windows are rows of their own, so that a long text is scored by many tasks, and one
aggregation gives each text its verdict. A model that fails fails the job: a text that was not screened never counts as clean.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions import screening, text

# Tokens of coarse and fine windows and their overlaps; a classifier sees two more, the marks at both ends.
COARSE, FINE = (510, 128), (64, 32)
# Characters of coarse windows and their overlap, and of the blocks of sentences that longer texts are cut into as well.
GUARD_WINDOW, GUARD_BLOCK = (1200, 200), 200
THRESHOLD = 0.5

#: From rows of token ids to rows of (benign, malicious) logits.
Scorer = Callable[[list[list[int]]], np.ndarray]


def starts(n: int, size: int, overlap: int) -> list[int]:
    """Starts of sliding windows; the last is the first to reach the end."""
    out = [0] if n else []
    while out and out[-1] + size < n:
        out.append(out[-1] + max(1, size - overlap))
    return out


def token_windows(ids: list[int]) -> list[list[int]]:
    """The coarse windows of a text and, if it is longer than one, its fine ones."""
    sizes = [COARSE, FINE] if len(ids) > FINE[0] else [COARSE]
    return [ids[s : s + size] for size, overlap in sizes for s in starts(len(ids), size, overlap)]


def tokenizer(path: str):  # noqa: ANN201
    """A tokenizer from its file, without the truncation and padding that such files may ask for."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def classified(texts: DataFrame, key: str, column: str, tokenizer_path: str, make_scorer: Callable[[], Scorer], threshold: float = THRESHOLD, batch: int = 64) -> DataFrame:
    """(key, score, reasons) of each text: the highest probability of an attack over its windows, and the reason if it reaches the threshold.

    Null, blank and wordless texts score 0. Of equal scores the first window counts. ``make_scorer`` is called once in each task.
    Rows of one key are one text's. The threshold must lie between 0 and 1.
    """
    if not 0 < threshold < 1:
        raise ValueError(f"the threshold {threshold} does not lie between 0 and 1")
    if not os.path.isfile(tokenizer_path):
        raise FileNotFoundError(tokenizer_path)
    definition = texts.sparkSession.sparkContext.broadcast(tokenizer(tokenizer_path).to_str())
    kind = texts.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(definition.value)
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for i, x in enumerate(b.column(1).to_pylist()):
                windows = token_windows(t.encode(x, add_special_tokens=False).ids) if x and x.strip() else []
                for no, w in enumerate(windows, 1):
                    for col, v in zip(rows, (i, no, len(windows), w)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), pa.array(rows[2], pa.int32()), pa.array(rows[3], pa.list_(pa.int32()))], names=["key", "no", "n", "ids"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Tokens = None
        ends: tuple[list[int], list[int]] = ([], [])
        for b in batches:
            if scorer is None:
                from tokenizers import Tokenizer as Tokens

                scorer = make_scorer()
                marks = Tokens.from_str(definition.value).encode("").ids
                ends = (marks[:1], marks[-1:]) if len(marks) >= 2 else ends
            ids = [ends[0] + w + ends[1] for w in b.column(3).to_pylist()]
            logits = [np.asarray(scorer(ids[i : i + batch]), np.float64).reshape(-1, 2) for i in range(0, len(ids), batch)]
            p = np.concatenate(logits) if logits else np.zeros((0, 2))
            top = p.max(axis=1, keepdims=True) if len(p) else p
            e = np.exp(p - top)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(e[:, 1] / e.sum(axis=1) if len(p) else [], pa.float64())], names=["key", "no", "n", "score"])

    windows = texts.select(F.col(key).alias("key"), F.col(column).alias("text")).mapInArrow(cut, f"key {kind}, no int, n int, ids array<int>")
    # the windows of a long text go to many tasks
    scored = windows.repartition(F.xxhash64("key", "no")).mapInArrow(score, f"key {kind}, no int, n int, score double")
    best = scored.groupBy("key").agg(F.max(F.struct("score", (-F.col("no")).alias("at"), "n")).alias("b"))
    reason = F.format_string("promptguard:score %.2f in window %d/%d", "b.score", -F.col("b.at"), "b.n")
    found = best.select(F.col("key").alias("_k"), F.col("b.score").alias("score"), F.when(F.col("b.score") >= threshold, F.array(reason)).alias("reasons"))
    every = texts.select(key).distinct()
    return every.join(found, every[key].eqNullSafe(found["_k"]), "left").select(key, F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("reasons", screening.none_found()).alias("reasons"))


def onnx_scorer(path: str) -> Callable[[], Scorer]:
    """A classifier in an ONNX file, for :func:`classified`. Raises at once if the file or the runtime is missing, or the model has inputs of other kinds."""
    if not os.path.isfile(path):
        raise FileNotFoundError(path)
    try:
        import onnxruntime
    except ImportError as e:
        raise RuntimeError(f"a classifier is set ({path}), but there is no runtime for it here") from e
    names = [i.name for i in onnxruntime.InferenceSession(path).get_inputs()]
    if odd := set(names) - {"input_ids", "attention_mask", "token_type_ids"}:
        raise ValueError(f"the model has inputs that can't be filled: {sorted(odd)}")

    def make() -> Scorer:
        import onnxruntime

        session = onnxruntime.InferenceSession(path)

        def run(ids: list[list[int]]) -> np.ndarray:
            width = max(map(len, ids))
            padded = np.array([w + [0] * (width - len(w)) for w in ids], np.int64)
            mask = np.array([[1] * len(w) + [0] * (width - len(w)) for w in ids], np.int64)
            feed = {"input_ids": padded, "attention_mask": mask, "token_type_ids": np.zeros_like(padded)}
            return session.run(None, {n: feed[n] for n in names})[0]

        return run

    return make


@dataclass(frozen=True)
class GuardEndpoint:
    """A guard model behind an endpoint that takes chat messages; it is called with a text and gives the reply."""

    url: str
    model: str
    timeout: float = 120.0

    def _open(self, path: str, body: dict | None = None) -> bytes:
        data = None if body is None else json.dumps(body).encode()
        request = urllib.request.Request(self.url.rstrip("/") + path, data, {"Content-Type": "application/json"} if data else {})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            if reply.status != 200:
                raise ConnectionError(f"{self.url} answers {reply.status}")
            return reply.read()

    def probe(self) -> None:
        """Raise if nothing answers there, before any job starts."""
        self._open("/models")

    def __call__(self, prompt: str) -> str:
        got = json.loads(self._open("/chat/completions", {"model": self.model, "messages": [{"role": "user", "content": prompt}], "temperature": 0, "max_tokens": 64}))
        if not got.get("choices"):
            raise ValueError(f"{self.url} gives no choice")
        return got["choices"][0]["message"]["content"].strip()


def guarded(texts: DataFrame, key: str, column: str, ask: Callable[[str], str]) -> DataFrame:
    """(key, reasons) of each text by a guard model: the reason of the first window whose reply flags it.

    Windows of 1,200 characters and, of texts longer than a block, blocks of sentences. Equal windows are asked about once. Null and blank texts have no reason.
    """
    t = F.col("text")
    every = F.concat(F.transform(text.windows(t, *GUARD_WINDOW), lambda w: w["window"]), F.when(F.length(t) > GUARD_BLOCK, text.segments(t)).otherwise(F.array().cast("array<string>")))
    cut = texts.select(F.col(key).alias("key"), F.col(column).alias("text")).filter(F.length(text.trim_space(t)) > 0)
    windows = cut.select("key", every.alias("w")).select("key", F.size("w").alias("n"), F.posexplode("w").alias("no", "window"))
    kind = texts.schema[key].dataType.simpleString()

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([ask(w) for w in b.column(0).to_pylist()], pa.string())], names=["window", "reply"])

    asked = windows.select("window").distinct().mapInArrow(reply, "window string, reply string")
    bad = asked.filter(screening.guard_decision(F.col("reply"))).select(F.col("window").alias("_w"), screening.guard_summary(F.col("reply")).alias("summary"))
    hits = windows.join(bad, F.col("window") == F.col("_w"))
    first = hits.groupBy("key").agg(F.min_by(F.struct("no", "n", "summary"), "no").alias("f"))
    found = first.select(F.col("key").cast(kind).alias("_k"), F.array(F.format_string("llmguard:%s in window %d/%d", "f.summary", F.col("f.no") + 1, "f.n")).alias("reasons"))
    names = texts.select(key).distinct()
    return names.join(found, names[key].eqNullSafe(found["_k"]), "left").select(key, F.coalesce("reasons", screening.none_found()).alias("reasons"))
