"""Language ID: averaged hashed subword embeddings under a linear softmax.

Every letter pair and letter triple (a word's border counts as one sign) is hashed to a row of
an embedding table; a text is the mean of its rows, and a linear layer with softmax names the
language. Table and layer are trained together by stochastic gradient descent in numpy on the
driver, on a bounded sample of labelled rows. As the layer is linear, table times layer is one
small table, which is what the executors get; prediction is a sum of its rows over the whole
text, taken in blocks, so long texts need no more memory than short ones.

Probabilities are calibrated by a temperature, and the score below which a prediction is
rejected is calibrated too, both on sampled rows that were not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from weftgraph.llm.common import held_out, id_and_text

#: Rows of the hashed table (row 0 stays zero), and the width of an embedding.
BUCKETS, WIDTH = 1 << 15, 12

#: Labelled rows of each language that the model may be trained and calibrated on, and code points
#: of each of these (a piece from any place of a longer text); every language is learned.
ROWS_PER_LANGUAGE, PIECE = 500, 20_000

#: Share of the texts predicted rightly in calibration that may be rejected, and the highest limit.
MISSED, HIGHEST = 0.002, 0.5

#: Code points that are hashed at a time.
BLOCK = 1 << 18

UNKNOWN = "und"
_SEED = 20


@cache
def _letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _blocks(text: str) -> Iterator[np.ndarray]:
    """Table rows of all letter pairs and triples of a text."""
    # The 'surrogatepass' is for Python callers; Spark's strings have no surrogates.
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    known = _letters()
    for at in range(0, len(points), BLOCK):
        part = points[max(0, at - 1) : at + BLOCK + 1]
        letter = known[part]
        c = np.zeros(len(part) + 2, np.uint32)
        c[1:-1] = np.where(letter, part, 0)
        middle = np.flatnonzero(letter[(at > 0) : (at > 0) + BLOCK]) + 1 + (at > 0)
        if len(middle):
            pair = c[middle] * np.uint32(0x9E3779B1) + c[middle + 1] * np.uint32(0x85EBCA77)
            triple = (pair ^ (c[middle - 1] * np.uint32(0xC2B2AE3D))) * np.uint32(0x27D4EB2F)
            rows = np.concatenate([pair * np.uint32(0x165667B1) >> np.uint32(17), triple >> np.uint32(17)])
            yield np.maximum(rows, 1).astype(np.intp)


@dataclass(frozen=True)
class Model:
    """What prediction needs: languages, their table and bias, and what was calibrated."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        total, n = np.zeros(len(self.languages)), 0
        for rows in _blocks(text):
            total += self.table[rows].sum(axis=0, dtype=np.float64)
            n += len(rows)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score, and whether the score is high enough."""
        z = self.logits(text or "") if self.languages else None
        if z is None:
            return UNKNOWN, 0.0, False
        p = _softmax(z / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] >= self.least)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    rows = [r for r in _blocks(text)]
    if not rows:
        return np.zeros(0, np.intp), np.zeros(0)
    found, n = np.unique(np.concatenate(rows), return_counts=True)
    return found, n / n.sum()


def _windows(text: str, rng: np.random.Generator, n: int) -> list[str]:
    """Short pieces of a text, so that short texts are seen in training too."""
    size = rng.integers(12, 120, n)
    return [text[s : s + k] for k in size for s in [int(rng.integers(0, max(1, len(text) - int(k))))]]


def train(sample: list[tuple[str, str]], epochs: int = 4, rate: float = 0.5) -> Model:
    """Model of (text, language) rows; every fifth of them only calibrates."""
    languages = tuple(sorted({lang for _, lang in sample}))
    if not languages:
        return Model((), np.zeros((BUCKETS, 0)), np.zeros(0))
    rng, number = np.random.default_rng(_SEED), {x: i for i, x in enumerate(languages)}
    fit, rest = [], []
    for i, (text, lang) in enumerate(sample):
        pieces = [text, *_windows(text, rng, 3)]
        (rest if i % 5 == 4 else fit).extend((p, number[lang], k == 0) for k, p in enumerate(pieces))
    table = rng.normal(0, 0.1, (BUCKETS, WIDTH))
    layer, bias = np.zeros((WIDTH, len(languages))), np.zeros(len(languages))
    seen = [(*_counted(p), y) for p, y, _ in fit]
    for step in range(epochs):
        pace = rate * (1 - step / epochs)
        for i in rng.permutation(len(seen)):
            rows, share, y = seen[i]
            if not len(rows):
                continue
            x = share @ table[rows]
            g = _softmax(x @ layer + bias)
            g[y] -= 1
            back = layer @ g
            layer -= pace * np.outer(x, g)
            bias -= 0.05 * pace * g
            table[rows] -= pace * 10 * share[:, None] * back
    model = Model(languages, (table @ layer).astype(np.float32), bias)
    judged = [(z, y, whole) for p, y, whole in rest or fit if (z := model.logits(p)) is not None]

    def loss(t: float) -> float:
        return -sum(np.log(max(_softmax(z / t)[y], 1e-12)) for z, y, _ in judged)

    heat = min(np.geomspace(0.25, 64, 33), key=loss) if judged else 1.0
    right = [p[y] for z, y, whole in judged if whole and (p := _softmax(z / heat)).argmax() == y]
    least = np.quantile(right, MISSED, method="lower") if right else HIGHEST
    return Model(languages, model.table, bias, float(heat), min(HIGHEST, float(least)))


def fit(docs: DataFrame, per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Model of text and lang of docs, without the rows that held_out() keeps back.

    Of each language about per_language rows, chosen by a hash of their id, and of these a piece of
    up to PIECE code points, whose place is chosen by the hash too. Rows without lang or text teach
    nothing; without any the model knows no language.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), docs["lang"].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    counts = rows.groupBy("lang").count().collect()  # a row for each language, of which the model has a column
    if not counts:
        return train([])
    below = F.create_map(*[F.lit(v) for r in counts for v in (r["lang"], int(min(1, per_language / r["count"]) * (1 << 30)))])
    chosen = rows.where(F.col("text").isNotNull() & (draw < F.try_element_at(below, F.col("lang"))))
    start = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text") - PIECE + 1, F.lit(1)))
    chosen = chosen.select("lang", F.substring("text", (start + 1).cast("int"), F.lit(PIECE)).alias("text"), draw.alias("draw"), "doc_id")
    return train([(r["text"], r["lang"]) for r in chosen.orderBy("draw", "doc_id", "text").collect()])


def predicted(text: Column, model: Model) -> Column:
    """struct<lang_pred, score, accepted> of a text column."""

    @pandas_udf("lang_pred string, score double, accepted boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.predict(t) for t in texts], columns=["lang_pred", "score", "accepted"])

    return run(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score (0 to 1) and accepted of every whole text.

    A null text and one without a letter are 'und' with score 0 and not accepted. Rows are
    judged one by one, so repeated rows agree, and of equally likely languages the first by name
    wins; texts are taken in blocks, whatever their length; other columns are ignored; no rows
    give no rows.
    """
    rows = id_and_text(docs).withColumn("_p", predicted(F.col("text"), model))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "_p.lang_pred", "_p.score", "_p.accepted")


def keep_known(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of docs whose language is known well enough, with their columns as they were.

    Null and empty texts and those without a letter go, repeated rows stay or go together, rows
    without doc_id are judged like others, and no rows give no rows.
    """
    names = docs.columns
    return docs.withColumn("_weft_language", predicted(F.col("text"), model)).where("_weft_language.accepted").select(*names)
