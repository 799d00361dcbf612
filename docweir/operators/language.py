"""Language detection by a model of letter n-grams, trained on texts whose language is known."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import batched

#: Letters that stand together in a gram, the grams that each language keeps, and the languages that a model may have.
SIZES, KEPT, LANGUAGES = (1, 2, 3), 6_000, 200
#: Characters below which nothing is said of a text, and those that are looked at. Fixed values.
SHORTEST, LOOKED_AT = 20, 5_000
#: What an unseen gram counts.
SMOOTH = 0.5
BITS = 21


def letters(text: str) -> np.ndarray:
    """Code points of the text's words in lower case, a blank before, between and behind them."""
    points = np.frombuffer(text[:LOOKED_AT].lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    known, back = np.unique(points, return_inverse=True)
    kept = np.array([p if chr(p).isalpha() else 32 for p in known.tolist()], np.int64)
    points = np.concatenate([[32], kept[back] if len(known) else kept, [32]])
    return points[np.append(True, (points[1:] != 32) | (points[:-1] != 32))]


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of a text, each a number made of its code points, and their counts. Grams of blanks alone don't count."""
    points, found = letters(text), []
    for size in SIZES:
        n = len(points) - size + 1
        if n > 0:
            key = np.zeros(n, np.int64)
            for k in range(size):
                key = key << BITS | points[k : k + n]
            found.append(key[key != 32])
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    keys: np.ndarray
    weights: np.ndarray  # a row of log probabilities for each key
    unseen: np.ndarray

    def detect(self, text: str | None) -> str | None:
        """The likeliest language; null for a text of fewer than SHORTEST characters, without letters, or for an empty model."""
        sample = (text or "").strip()
        if len(sample) < SHORTEST or not self.languages:
            return None
        key, n = grams(sample)
        if not len(key):
            return None
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        here = self.keys[at] == key
        score = n[here] @ self.weights[at[here]] + n[~here].sum() * self.unseen
        return self.languages[int(score.argmax())]


def train(samples: DataFrame) -> Model:
    """A model of samples (language, text), all of them: grouped sums of grams by language, of which each keeps its KEPT commonest.

    Rows without a language or text, and texts too short to be detected, teach nothing. Tasks add up their own grams before
    the shuffle. LANGUAGES bounds what reaches the driver, beyond which it is an error.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            new: dict[str, list] = {}
            for language, text in zip(batch.column("language").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if len(text.strip()) >= SHORTEST:
                    new.setdefault(language, []).append(grams(text.strip()))
            for language, found in new.items():
                if language in held:
                    found.append(held[language])
                keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
                held[language] = keys, np.bincount(back, np.concatenate([n for _, n in found]), len(keys)).astype(np.int64)
            if sum(len(k) for k, _ in held.values()) > 2_000_000:
                yield from _rows(held)
                held = {}
        yield from _rows(held)

    rows = samples.select("language", "text").filter("language is not null and text is not null")
    summed = batched(rows).mapInArrow(count, "language string, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n"))
    first = F.row_number().over(W.partitionBy("language").orderBy(F.desc("n"), "gram"))
    kept = summed.withColumn("r", first).filter(F.col("r") <= KEPT).groupBy("language").agg(F.collect_list(F.struct("gram", "n")).alias("grams"))
    found = kept.limit(LANGUAGES + 1).collect()
    if len(found) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    found.sort(key=lambda r: r.language)
    keys = np.unique(np.array([g.gram for r in found for g in r.grams], np.int64))
    counts = np.zeros((len(keys), len(found)))
    for k, r in enumerate(found):
        counts[np.searchsorted(keys, [g.gram for g in r.grams]), k] = [g.n for g in r.grams]
    total = counts.sum(axis=0) + SMOOTH * (len(keys) + 1)
    return Model([r.language for r in found], keys, np.log((counts + SMOOTH) / total), np.log(SMOOTH / total))


def _rows(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for language, (keys, n) in held.items():
        yield pa.RecordBatch.from_arrays([pa.array([language] * len(keys), pa.string()), pa.array(keys), pa.array(n)], names=["language", "gram", "n"])


def detect(docs: DataFrame, model: Model, out: str = "detected") -> DataFrame:
    """docs with the language that the model finds in text, in one Arrow pass."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([sent.value.detect(t) for t in batch.column("text").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, out])

    return batched(docs).mapInArrow(run, schema)
