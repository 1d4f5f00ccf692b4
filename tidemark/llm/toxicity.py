"""Toxicity by class-conditional Kneser-Ney models of words' characters.

A word is a maximal run of letters and marks, lower-cased, after three start marks and
before an end mark; its expressions are the runs of four characters in that. Toxic and
ordinary rows have counts of their own for runs of four and three; both back off to the
same counts of two and one, which come from all documents. So an expression that a class
has hardly seen costs both classes alike, and a document's log-likelihood ratio is a sum
over its expressions of one number each.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.chunks import slices
from tidemark.llm.shared import discard, written
from tidemark.llm.shingles import _mix

ORDER = 4
START, END = "\x02", "\x03"
FOLDS, HELD, CALIBRATION = 5, 0, 4  # rows' crc32 of the id modulo FOLDS: HELD are never learned from, CALIBRATION sets the scale
LABELLED = 50_000  # rows learned from, of each class at most (as a share of them by hash)
BLOCK = 2_000_000  # expressions whose ratios are broadcast at once
PSEUDO = 20  # words of ratio zero that every document has besides its own: short texts lean to the middle
FLUSH = 500_000


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words' expressions, four a row, and the number of expressions of each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    joined = START * (ORDER - 1) + (END + START * (ORDER - 1)).join(words) + END
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    rows = np.lib.stride_tricks.sliding_window_view(points, ORDER)
    inside = np.ones(len(rows), bool)
    after = np.cumsum(lengths + ORDER)  # where the next word's start marks begin
    for k in range(1, ORDER):
        inside[(after - k)[:-1]] = False
    return rows[inside], lengths + 1


def _hash(codes: np.ndarray) -> np.ndarray:
    a, b, c, d = (codes[:, k].astype(np.uint64) for k in range(ORDER))
    with np.errstate(over="ignore"):
        return _mix(_mix(a << np.uint64(32) | b) + np.uint64(0x9E3779B97F4A7C15) * (c << np.uint64(32) | d))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of some texts, the place among them of every word, and the bounds of each text's words."""
    split = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\p{L}\p{M}]+")
    counts, flat = pc.list_value_length(split).to_numpy(zero_copy_only=False), split.flatten()
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.cumsum(full)])[np.concatenate([[0], np.cumsum(counts)])]
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), bounds


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expressions with their counts in toxic rows, ordinary rows and all rows of a task; each once, unless there are very many."""
    keys, sums, grams = np.zeros(0, np.uint64), np.zeros((0, 3), np.int64), np.zeros((0, ORDER), np.uint32)

    def record() -> pa.RecordBatch:
        text = np.ascontiguousarray(grams).tobytes().decode("utf-32-le", "surrogatepass")
        return pa.RecordBatch.from_arrays([pa.array([text[k : k + ORDER] for k in range(0, len(text), ORDER)], pa.string()), *[pa.array(sums[:, k]) for k in range(3)]], ["g", "toxic", "ordinary", "total"])

    for batch in slices(batches):
        words, at, bounds = _words(batch.column(0))
        if not len(at):
            continue
        codes, lengths = _codes(words.to_pylist())
        kind = np.repeat(pc.fill_null(batch.column(1), -1).to_numpy(zero_copy_only=False), np.diff(bounds))
        by = np.stack([np.bincount(at[kind == 1], minlength=len(words)), np.bincount(at[kind == 0], minlength=len(words)), np.bincount(at, minlength=len(words))], 1)
        keys, sums, grams = np.concatenate([keys, _hash(codes)]), np.concatenate([sums, np.repeat(by, lengths, axis=0)]), np.concatenate([grams, codes])
        order = np.argsort(keys, kind="stable")
        starts = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) > 0]))
        keys, sums, grams = keys[order[starts]], np.add.reduceat(sums[order], starts, axis=0), grams[order[starts]]
        if len(keys) > FLUSH:
            yield record()
            keys, sums, grams = keys[:0], sums[:0], grams[:0]
    yield record()


def _discounts(counts: DataFrame, *columns: str) -> list[list[float]]:
    """For each column of counts the discounts of one, two and more, by the counts of counts."""
    row = counts.agg(*[F.count_if(F.col(c) == k).alias(f"{c}{k}") for c in columns for k in range(1, 5)]).first()
    out = []
    for c in columns:
        n = [0, *(row[f"{c}{k}"] for k in range(1, 5))]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else None
        out.append([0.75 if y is None or not n[k] else min(max(k - (k + 1) * y * n[k + 1] / n[k], 0.05), 0.95 * k) for k in (1, 2, 3)])
    return out


def _interpolated(count: str, lower: F.Column, discounts: list[float]) -> F.Column:
    """Kneser-Ney after the context ``h``: discounted counts' shares, and what was taken off them by the lower order; that alone if the context has no counts."""
    c, same = F.col(count), Window.partitionBy("h")
    off = F.when(c == 0, 0.0).when(c == 1, discounts[0]).when(c == 2, discounts[1]).otherwise(discounts[2])
    total = F.sum(c).over(same)
    return F.when(total > 0, (c - off + F.sum(off).over(same) * lower) / total).otherwise(lower)


def expression_ratios(grams: DataFrame) -> DataFrame:
    """(g, r): the log of toxic against ordinary probability of each expression's last character after the others.

    ``grams`` has every expression once, with its counts toxic, ordinary and total. Lower
    orders count the distinct characters before an expression: those of order 3 in rows of
    the class, those of orders 2 and 1 in all rows.
    """
    three = written(grams.groupBy(F.substring("g", 2, 3).alias("g")).agg(F.count_if(F.col("toxic") > 0).alias("toxic"), F.count_if(F.col("ordinary") > 0).alias("ordinary")))
    two = three.groupBy(F.substring("g", 2, 2).alias("g")).agg(F.count("*").alias("c"))
    one = two.groupBy(F.substring("g", 2, 1).alias("g")).agg(F.count("*").alias("c"))
    (d2,), (d1,) = _discounts(two, "c"), _discounts(one, "c")
    p1 = one.withColumn("h", F.lit("")).select("g", _interpolated("c", F.lit(1 / (one.count() + 1)), d1).alias("p1"))
    p2 = two.withColumn("h", F.substring("g", 1, 1)).withColumn("low", F.substring("g", 2, 1)).join(p1.withColumnRenamed("g", "low"), "low").select("g", _interpolated("c", F.col("p1"), d2).alias("p2"))
    levels = p2.select("g", F.col("p2").alias("pt"), F.col("p2").alias("po"))
    for counts in (three, grams):
        size = ORDER if counts is grams else ORDER - 1
        dt, do = _discounts(counts, "toxic", "ordinary")
        rows = counts.withColumn("h", F.substring("g", 1, size - 1)).withColumn("low", F.substring("g", 2, size - 1)).join(levels.withColumnRenamed("g", "low"), "low")
        levels = rows.select("g", _interpolated("toxic", F.col("pt"), dt).alias("pt"), _interpolated("ordinary", F.col("po"), do).alias("po"))
    ratios = written(levels.select("g", F.log(F.col("pt") / F.col("po")).alias("r")))
    discard(three)
    return ratios


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        points = np.frombuffer("".join(batch.column(0).to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER)
        yield pa.RecordBatch.from_arrays([pa.array(_hash(points).view(np.int64)), batch.column(1).cast(pa.float32())], ["k", "r"])


def _add(batches: Iterator[pa.RecordBatch], table, last: bool) -> Iterator[pa.RecordBatch]:
    """Add the ratios that a block of them has for the texts' expressions."""
    keys, ratios = table.value
    for batch in slices(batches):
        words, at, bounds = _words(batch.column(1))
        sums = np.zeros(batch.num_rows)
        if len(at) and len(keys):
            codes, lengths = _codes(words.to_pylist())
            own = _hash(codes)
            place = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            found = np.where(keys[place] == own, ratios[place], np.float32(0)).astype(float)
            each = np.add.reduceat(found, np.concatenate([[0], np.cumsum(lengths)[:-1]]))
            running = np.concatenate([[0.0], np.cumsum(each[at])])
            sums = running[bounds[1:]] - running[bounds[:-1]]
        total = pa.array(sums + batch.column(2).to_numpy())
        if last:
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.divide(total, pa.array(np.diff(bounds) + float(PSEUDO)))], ["doc_id", "x"])
        else:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), total], ["doc_id", "text", "s"])


def _mean_ratios(docs: DataFrame, ratios: DataFrame, block: int) -> DataFrame:
    """(doc_id, x): each row's summed ratios by its words and ``PSEUDO`` more. Ratios are broadcast a block at a time, and the texts pass once a block."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    keyed, blocks = ratios.select("g", "r").mapInArrow(_keyed, "k long, r float"), max(1, -(-ratios.count() // block))
    rows = docs.withColumn("s", F.lit(0.0))
    for b in range(blocks):
        table = keyed.where(F.pmod("k", F.lit(blocks)) == b).toArrow()
        keys = table.column("k").to_numpy().view(np.uint64)
        order = np.argsort(keys)
        shared = spark.sparkContext.broadcast((keys[order], table.column("r").to_numpy()[order]))
        last = b == blocks - 1
        rows = written(rows.mapInArrow(partial(_add, table=shared, last=last), f"doc_id {kind}, x double" if last else f"doc_id {kind}, text string, s double"))
    return rows


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step function nearest to y: both ends of each step."""
    places, at = np.unique(x, return_inverse=True)
    steps: list[list[float]] = []  # sum, rows, least x, greatest x
    for place, total, n in zip(places.tolist(), np.bincount(at, y).tolist(), np.bincount(at).tolist()):
        steps.append([total, n, place, place])
        while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
            s, n, _, high = steps.pop()
            steps[-1] = [steps[-1][0] + s, steps[-1][1] + n, steps[-1][2], high]
    return np.array([v for s in steps for v in s[2:]]), np.array([s[0] / s[1] for s in steps for _ in "ab"])


def _scored(batches: Iterator[pa.RecordBatch], knots: np.ndarray, shares: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.interp(batch.column(2).to_numpy(), knots, shares)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])


def labelled_sample(labels: DataFrame, most: int = LABELLED) -> DataFrame:
    """(doc_id, toxic, fold): labelled ids that are learned from, at about ``most`` of each class: all, or those whose hash is low enough.

    A doc_id with several labels is toxic if any says 1; null ids and labels teach nothing.
    """
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    learned = one.withColumn("fold", fold.cast("int")).where(F.col("fold") != HELD)
    counts = {r["toxic"]: r["count"] for r in learned.groupBy("toxic").count().collect()}
    rate = F.when(F.col("toxic") == 1, most / max(counts.get(1, 1), 1)).otherwise(most / max(counts.get(0, 1), 1))
    return written(learned.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < rate * (1 << 20)))


def score_toxicity(docs: DataFrame, labels: DataFrame, most: int = LABELLED, block: int = BLOCK) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score (0 to 1) and predicted (1 from a score of 0.5 on).

    ``docs`` has doc_id and text, ``labels`` doc_id and toxic; other columns are not read.
    Rows whose crc32(doc_id) modulo 5 is 0, or without an id, are held out. Of the labelled
    others at most about ``most`` a class are learned from: three of four give the classes'
    counts, the fourth part sets the scale, by isotonic regression of the labels on the
    length-normalised log-likelihood ratio (on all of them, if it lacks a class). The shared
    counts are of all documents, whole. A null or empty text has ratio 0. Without rows
    of both classes the score is the share of toxic ones learned from, 0 without any.

    The texts are read twice and never shuffled: what moves is each task's expressions with
    their counts. Their ratios are broadcast ``block`` rows (24 MB) at most at once.
    """
    docs = docs.select("doc_id", "text")
    sample = labelled_sample(labels, most)
    counted = docs.join(F.broadcast(sample.where(F.col("fold") != CALIBRATION).select("doc_id", "toxic")), "doc_id", "left").select("text", "toxic")
    grams = written(counted.mapInArrow(_count, "g string, toxic long, ordinary long, total long").groupBy("g").agg(*[F.sum(c).alias(c) for c in ("toxic", "ordinary", "total")]))
    ratios = expression_ratios(grams)
    means = _mean_ratios(docs, ratios, block)
    seen = means.join(F.broadcast(sample), "doc_id").select("x", "toxic", "fold").toPandas()
    scale = seen[seen.fold == CALIBRATION]
    scale = scale if scale.toxic.nunique() == 2 else seen
    knots, shares = isotonic(scale.x.to_numpy(), scale.toxic.to_numpy()) if scale.toxic.nunique() == 2 else (np.zeros(1), np.array([float(scale.toxic.mean()) if len(scale) else 0.0]))
    discard(sample, grams, ratios)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD, F.lit(True))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return means.select("doc_id", held.alias("held_out"), "x").mapInArrow(partial(_scored, knots=knots, shares=shares), f"doc_id {kind}, held_out boolean, score double, predicted int")
