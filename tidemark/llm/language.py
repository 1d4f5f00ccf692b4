"""Language identification with string kernels, Nyström landmarks and kernel ridge regression."""

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chunks import slices

BITS = 15  # n-grams are hashed into 2**BITS presence features
SPECTRUM = (1, 2, 3)
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
MIN_SCORE = 0.5  # a score above it means that a classifier claims the text
MANY = 64  # languages up to which each has its full sample and landmarks; more share as many, but have ``LEAST`` rows and one landmark
LEAST = 20


def ngrams(text: str) -> np.ndarray:
    """Presence of the blended spectrum's n-grams of the lower-cased whole text, over hashed features."""
    present = np.zeros(1 << BITS, bool)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    for n in SPECTRUM:
        if len(codes) >= n:
            mixed = np.full(len(codes) - n + 1, n, np.uint64)
            for k in range(n):
                mixed += codes[k : len(codes) - n + 1 + k]
                mixed *= _MULTIPLIERS[k]
            mixed ^= mixed >> np.uint64(29)
            mixed *= _MULTIPLIERS[0]
            present[mixed >> np.uint64(64 - BITS)] = True
    return present


@dataclass
class KernelModel:
    """Landmarks (presence, one row each) and the coefficients of their kernel values, a column per language."""

    languages: list[str]
    landmarks: np.ndarray
    coefficients: np.ndarray

    def __post_init__(self):
        self.columns = np.flatnonzero(self.landmarks.any(0))
        self.dense = self.landmarks[:, self.columns].T.astype(np.float32)
        self.norms = np.sqrt(np.maximum(self.landmarks.sum(1), 1)).astype(np.float32)

    def kernel(self, rows: list[np.ndarray]) -> np.ndarray:
        """Normalised presence kernel of texts and landmarks: one matrix product for the whole batch."""
        sizes = np.sqrt(np.maximum([r.sum() for r in rows], 1)).astype(np.float32)
        return (np.stack([r[self.columns] for r in rows]).astype(np.float32) @ self.dense) / sizes[:, None] / self.norms

    def predict(self, texts: list[str | None], batch: int = 256) -> tuple[list[str], list[float]]:
        """A language and a score from 0 to 1 for each text; ``und`` and 0 without a letter or a model."""
        names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t and _LETTER.search(t)] if self.languages else []
        for at in range(0, len(known), batch):
            part = known[at : at + batch]
            values = self.kernel([ngrams(texts[i]) for i in part]) @ self.coefficients
            for i, row in zip(part, values):
                best = int(np.argmax(row))
                names[i], scores[i] = self.languages[best], float(np.clip((1 + row[best]) / 2, 0, 1))
        return names, scores


def fit(rows: list[tuple[str, np.ndarray]], per_language: int = 40, ridge: float = 1e-2) -> KernelModel:
    """One-versus-rest kernel ridge regression in the Nyström feature space of the first rows of each language.

    Rows are presences or, packed, their bits; they are unpacked a batch at a time.
    """
    languages = sorted({r[0] for r in rows})
    if not languages:
        return KernelModel([], np.zeros((0, 1 << BITS), bool), np.zeros((0, 0), np.float32))
    column = {name: k for k, name in enumerate(languages)}
    per_language = max(1, min(per_language, MANY * per_language // len(languages)))
    loose = lambda r: r if r.dtype == bool else np.unpackbits(r).astype(bool)
    seen = dict.fromkeys(languages, 0)
    chosen = []
    for name, present in rows:
        seen[name] += 1
        if seen[name] <= per_language:
            chosen.append(loose(present))
    model = KernelModel(languages, np.stack(chosen), np.zeros((len(chosen), len(languages)), np.float32))
    values, vectors = np.linalg.eigh(model.kernel(chosen).astype(np.float64))
    keep = values > 1e-6 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])
    gram = ridge * len(rows) / 100 * np.eye(whiten.shape[1])
    moment = np.zeros((whiten.shape[1], len(languages)))
    for at in range(0, len(rows), 1024):
        part = rows[at : at + 1024]
        features = model.kernel([loose(r[1]) for r in part]).astype(np.float64) @ whiten
        target = np.full((len(part), len(languages)), -1.0)
        target[np.arange(len(part)), [column[r[0]] for r in part]] = 1.0
        # Each language weighs the same, however many rows it has.
        weight = (len(rows) / len(languages) / np.array([seen[r[0]] for r in part], float))[:, None]
        gram += features.T @ (weight * features)
        moment += features.T @ (weight * target)
    model.coefficients = (whiten @ np.linalg.solve(gram, moment)).astype(np.float32)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample: int = 300, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> KernelModel:
    """Fit on at most ``sample`` labelled rows of every language; of more than ``MANY`` each has fewer rows.

    The rows are those of the lowest hashes of doc_id, among rows that are not held
    out. Their n-grams, not their texts, come to the driver: 4 KB a row.
    """
    ids = docs.select(docs[doc_id].alias("doc_id"), docs[lang].alias("lang")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull())
    many = ids.select("lang").distinct().count()
    sample = min(sample, max(LEAST, MANY * sample // max(1, many)))
    order = F.xxhash64("doc_id").alias("order")
    # Each task keeps the first rows of its languages before they meet, and one window ranks the rest.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("order", "doc_id"))
    picked = ids.select("doc_id", "lang", order).withColumn("rank", rank).where(F.col("rank") <= sample).drop("rank")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [np.packbits(ngrams(x.as_py() or "")).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["order", "label", "bits"])

    picked = F.broadcast(picked.distinct().withColumnRenamed("doc_id", "id"))  # at most sample rows a language
    texts = docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("t")).join(picked, F.col("doc_id") == F.col("id")).select("order", F.col("lang").alias("label"), "t")
    rows = texts.mapInArrow(bits, "order long, label string, bits binary").collect()
    rows.sort(key=lambda r: (r["order"], r["label"], bytes(r["bits"])))
    return fit([(r["label"], np.frombuffer(bytes(r["bits"]), np.uint8)) for r in rows])


def predict(docs: DataFrame, model: KernelModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; nothing is shuffled.

    Only the text is an input of the prediction. A null text, or one without a
    letter, is ``und`` with score 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, np.packbits(model.landmarks, axis=1), model.coefficients))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, packed, coefficients = shared.value
        loaded = KernelModel(languages, np.unpackbits(packed, axis=1).astype(bool), coefficients)
        for batch in batches:
            names, scores = loaded.predict(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    chosen = docs.select(docs[doc_id].alias("doc_id"), held_out(docs[doc_id]).alias("held_out"), docs[text].alias("text"))
    return chosen.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from the rows that are not held out, and predict all rows."""
    return predict(docs, train(docs, doc_id=doc_id, text=text, lang=lang), doc_id, text)


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_score: float = MIN_SCORE) -> DataFrame:
    """The documents whose language can be told, with the prediction as their language; other columns as they were.

    A document goes if its text is null or has no letter, or if no language's
    classifier scores it above ``min_score``: at 0.5 all of them vote against it. Repeated
    rows and null ids stay.
    """
    model = train(docs, doc_id=doc_id, text=text, lang=lang)
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, np.packbits(model.landmarks, axis=1), model.coefficients))
    at, to = docs.columns.index(text), docs.columns.index(lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, packed, coefficients = shared.value
        loaded = KernelModel(languages, np.unpackbits(packed, axis=1).astype(bool), coefficients)
        for batch in slices(batches, 1000):
            names, scores = loaded.predict(batch.column(at).to_pylist())
            columns = [pa.array(names, pa.string()) if i == to else batch.column(i) for i in range(batch.num_columns)]
            told = pa.array([n != UNKNOWN and s > min_score for n, s in zip(names, scores)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(told)

    return docs.mapInArrow(run, docs.schema)
