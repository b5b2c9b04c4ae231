"""Quality classifier: a Gaussian-kernel ridge score by random Fourier features.

Statistics of each whole text are standardised and mapped to random Fourier features, whose
inner products approximate a Gaussian kernel. Each partition sums its part of the normal
equations; the sums are added up in a tree, and the driver solves one system of the fixed
size FEATURES. Ridge scores become probabilities by isotonic regression on rows that the
system did not see. Only the text of a document enters its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import held_out, id_and_text, stash

FEATURES, RIDGE, WIDTH = 192, 1e-3, 1.0

#: Labelled rows that isotonic regression gets; partitions' sums that one task adds up.
CALIBRATION_ROWS, FAN = 20_000, 16

#: predicted is 1 from this score on.
ACCEPT = 0.7
_SEED = 3

NAMES = (
    "log_chars", "lower", "upper", "digit", "space", "newline", "stop", "bang", "symbol", "high", "word_length",
    "log_words", "new_words", "new_lines", "log_line", "line_stops", "word_marks", "alternation",
)


@cache
def _kinds() -> np.ndarray:
    """Kind of each code point: lower, upper, digit, space, newline, stop, bang, symbol, other letter."""
    kinds = np.full(0x110000, 7, np.uint8)
    for i in range(0x30000):
        c = chr(i)
        kinds[i] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c.isspace() else 8 if c.isalpha() else 7
    kinds[10] = 4
    kinds[[ord(c) for c in ".,;:?'\"()-"]] = 5
    kinds[ord("!")] = 6
    return kinds


def statistics(text: str) -> list[float]:
    """The values of NAMES for one whole text; all are finite, also for an empty one."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(1, len(points))
    kinds = _kinds()[np.minimum(points, 0x10FFFF)]
    counts = np.bincount(kinds, minlength=9)
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    ends = sum(line.rstrip().endswith((".", "!", "?")) for line in lines)
    marks = sum(not x[-1].isalnum() for x in words)
    turns = int(np.count_nonzero(kinds[1:] != kinds[:-1]))
    return [
        np.log1p(len(points)),
        *(counts[:8] / n),
        counts[8] / n,
        min(sum(map(len, words)) / w, 50.0) / 10,
        np.log1p(len(words)),
        len(set(words)) / w,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        ends / len(lines),
        marks / w,
        turns / n,
    ]


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and stats (array of the values of NAMES) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "stats"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, stats array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def lifted(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        x = np.clip((stats - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.directions + self.phase) * np.sqrt(2 / len(self.phase))
        return np.hstack([z, np.ones((len(z), 1))])

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.interp(self.lifted(stats) @ self.weights, self.knots, self.levels)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (mean x of a pool) and their rising levels."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # sum of x, sum of y, rows
    for a, b in zip(x[order], y[order], strict=True):
        pools.append([float(a), float(b), 1.0])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[2] for p in pools]), np.array([p[1] / p[2] for p in pools])


def _stacked(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["stats"].to_numpy()).astype(float) if len(frame) else np.zeros((0, len(NAMES)))


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """Model of measured documents and labels(doc_id, quality); None without labelled rows.

    Rows that held_out() keeps back are not used; of several labels of an id the largest holds.
    One in five of the others only calibrates.
    """
    marks = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["quality"].cast("double").alias("y"))
    marks = marks.where(F.col("y").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = stats.where(~held_out(F.col("doc_id"))).join(marks, "doc_id")
    rows = stash(rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(5))), "labelled")
    fitted = rows.where("part > 0")
    moments = fitted.agg(F.count("*"), *[f(F.col("stats")[i]) for i in range(len(NAMES)) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return None
    mean, scale = np.array(moments[1::2]), np.array(moments[2::2])
    rng = np.random.default_rng(_SEED)
    model = Model(
        mean, np.where(scale > 1e-9, scale, 1.0), rng.normal(0, 1 / (WIDTH * np.sqrt(len(NAMES))), (len(NAMES), FEATURES)),
        rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), np.zeros(1), np.zeros(1),
    )

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for frame in frames:
            z = model.lifted(_stacked(frame))
            total += z.T @ np.hstack([z, frame[["y"]].to_numpy(float)])
        yield pd.DataFrame({"total": [total.tobytes()]})

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = sum((np.frombuffer(b) for frame in frames for b in frame["total"]), np.zeros((FEATURES + 1) * (FEATURES + 2)))
        yield pd.DataFrame({"total": [total.tobytes()]})

    # A tree: each level has a FANth of the sums before, and the driver gets at most FAN of them.
    sums, left = fitted.select("stats", "y").mapInPandas(partial, "total binary"), fitted.rdd.getNumPartitions()
    while left > FAN:
        left = -(-left // FAN)
        sums = sums.repartition(left).mapInPandas(add, "total binary")
    total = sum(np.frombuffer(r["total"]) for r in sums.collect()).reshape(FEATURES + 1, FEATURES + 2)
    gram, right = total[:, :-1], total[:, -1]
    weights = np.linalg.solve(gram + RIDGE * moments[0] * np.eye(FEATURES + 1) / FEATURES, right)
    model = Model(model.mean, model.scale, model.directions, model.phase, weights, model.knots, model.levels)
    seen = rows.where("part = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS).select("stats", "y").toPandas()
    if not len(seen):
        seen = fitted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION_ROWS).select("stats", "y").toPandas()
    knots, levels = isotonic(model.lifted(_stacked(seen)) @ weights, seen["y"].to_numpy(float))
    return Model(model.mean, model.scale, model.directions, model.phase, weights, knots, np.clip(levels, 0, 1))


def score(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, score, predicted of measured documents; without a model 0.5 and 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            values = model.scores(rows) if model else np.full(len(rows), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], ["doc_id", "score"])

    out = stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that are labelled and not held out.

    A null text is an empty one, and texts are taken whole, whatever their length. Repeated rows are
    scored alike, and ties are no special case, as rows are scored one by one. Rows without doc_id are
    scored but teach nothing. Other columns are ignored; no documents give no rows.
    """
    stats = stash(measure(docs), "stats")
    return score(stats, fit(stats, labels))
