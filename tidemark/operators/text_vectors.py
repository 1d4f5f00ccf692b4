"""Fitted text vectors: TF-IDF over a kept vocabulary, latent semantic vectors on top, and a hook for other embeddings."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.retrieval import cosine
from tidemark.session import checkpointed
from tidemark.sources.tables import table

FEATURES, COMPONENTS = 384, 64
HELD = 400_000  # terms that a task counts before it sends them
PIECE = 1 << 23  # bytes of text that are cut into words at once
GRAM, BLOCK = 1024, 1 << 22  # terms whose products are all summed at once; entries of a dense block of weights
#: English function words; other words are given to ``fit_text_model``.
STOP_WORDS = tuple("a an the this that these those i you he she it we they me him her us them my your his its our their who whom which what where when why how and or but nor if then else because while as until of at by for with about against between into through during before after above below to from up down in out on off over under again further once here there all any both each few more most other some such no not only own same so than too very is am are was were be been being have has had having do does did doing can could will would shall should may might must".split())

#: A function from rows (id, words) to rows (id, vector): what ``search`` takes in place of the vectors fitted here.
Embed = Callable[[DataFrame], DataFrame]


def _spaced(lowered: pa.Array) -> pa.Array:
    """Lower-cased texts with nothing but spaces between their words, one or more."""
    return pc.replace_substring_regex(lowered, pattern=r"[^\p{L}\p{N}_ ]+", replacement=" ")


def _terms(spaced: str | None, stop_words: frozenset[str]) -> list[str]:
    """The words of two characters or more that are no stop words, and the pairs of neighbours among them."""
    kept = [w for w in (spaced or "").split(" ") if len(w) > 1 and w not in stop_words]
    return kept + list(map(" ".join, zip(kept, kept[1:])))


def _kept(words: pa.Array, stop_words: frozenset[str]) -> pa.Array:
    """Which words count, as ``_terms`` has it."""
    return pc.and_(pc.greater(pc.utf8_length(words), 1), pc.invert(pc.is_in(words, value_set=pa.array(sorted(stop_words), words.type))))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.ListArray]:
    """The words of each text, empty ones among them, of about ``PIECE`` bytes of text at a time."""
    for batch in batches:
        step = max(batch.num_rows * PIECE // max(batch.nbytes, 1), 1)
        for start in range(0, batch.num_rows, step):
            yield pc.split_pattern(_spaced(batch.column(0).slice(start, step)), " ")


def _summed(parts: Iterable[pa.Table], most: int) -> Iterator[pa.RecordBatch]:
    """The parts' counts added up by term, sent on whenever about ``most`` terms are held."""

    def added() -> pa.Table:
        names = held[0].column_names[1:]
        return pa.concat_tables(held).group_by("term", use_threads=False).aggregate([(c, "sum") for c in names]).select(["term", *[f"{c}_sum" for c in names]]).rename_columns(["term", *names])

    held, n = [], 0
    for part in parts:
        held.append(part)
        n += part.num_rows
        if n > most:
            held = [added()]
            n = held[0].num_rows
            if n > most // 2:
                yield from held[0].to_batches()
                held, n = [], 0
    if held:
        yield from added().to_batches()


def _words(batches: Iterator[pa.RecordBatch], stop_words: frozenset[str], most: int) -> Iterator[pa.RecordBatch]:
    """Per task, about ``most`` words at a time: words, and how often they occur."""

    def counted(words: pa.ListArray) -> pa.Table:
        found = pc.value_counts(words.flatten())
        return pa.table({"term": found.field("values"), "n": found.field("counts")}).filter(_kept(found.field("values"), stop_words))

    return _summed(map(counted, _split(batches)), most)


def _counted(batches: Iterator[pa.RecordBatch], stop_words: frozenset[str], left: frozenset[str], right: frozenset[str] | None, most: int) -> Iterator[pa.RecordBatch]:
    """Per task: words of ``left``, and their pairs with a next word of ``right`` (None: any), how often they occur, and in how many texts."""
    known = None if right is None else pa.array(sorted(left | right), pa.string())

    def counted(words: pa.ListArray) -> pa.Table:
        flat = words.flatten()
        kept = _kept(flat, stop_words)
        flat, doc = flat.filter(kept), pc.list_parent_indices(words).filter(kept).to_numpy().astype(np.int64)
        if known is None:
            coded = flat.dictionary_encode()
            names, code = coded.dictionary.to_pylist(), coded.indices
        else:
            names, code = known.to_pylist(), pc.fill_null(pc.index_in(flat, value_set=known), -1)
        code = code.to_numpy(zero_copy_only=False).astype(np.int64)
        first = np.array([w in left for w in names] + [False])  # the last: a word that is not known
        second = np.array([right is None or w in right for w in names] + [False])
        one = np.flatnonzero(first[code])
        two = np.flatnonzero(first[code[:-1]] & second[code[1:]] & (doc[1:] == doc[:-1]))
        base = len(names) + 1
        terms, at, n = np.unique(np.r_[code[one] * base + len(names), code[two] * base + code[two + 1]], return_inverse=True, return_counts=True)
        docs = np.bincount(np.unique(np.r_[doc[one], doc[two]] * len(terms) + at) % max(len(terms), 1), minlength=len(terms))
        ends = ["", *[f" {w}" for w in names]]
        texts = [names[a] + ends[(b + 1) % base] for a, b in zip((terms // base).tolist(), (terms % base).tolist())]
        return pa.table({"term": pa.array(texts, pa.string()), "n": pa.array(n, pa.int64()), "docs": pa.array(docs, pa.int64())})

    return _summed(map(counted, _split(batches)), most)


@dataclass(frozen=True)
class TextModel:
    """A vocabulary with the weight of each term's rarity, fitted once and applied to any texts."""

    terms: tuple[str, ...]
    idf: tuple[float, ...]
    n_docs: int
    stop_words: tuple[str, ...]

    def weights(self, texts: DataFrame, id: str, text: str) -> DataFrame:
        """(id, terms, weights): places in the vocabulary that a text has, rising, and their weights of Euclidean norm 1.

        A weight is the term's count times ln((1 + documents) / (1 + documents with it)) + 1. A
        text that is null or has no term of the vocabulary has empty lists. Nothing is shuffled.
        """
        place, idf, stop_words = {t: k for k, t in enumerate(self.terms)}, np.array(self.idf), frozenset(self.stop_words)
        kind = texts.schema[id].dataType.simpleString()

        def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                terms, weights = [], []
                for spaced in _spaced(batch.column(1)):
                    counts = Counter(place[t] for t in _terms(spaced.as_py(), stop_words) if t in place)
                    at = np.array(sorted(counts), np.int64)
                    w = np.array([counts[k] for k in at.tolist()], float) * idf[at] if len(at) else np.zeros(0)
                    terms.append(at)
                    weights.append(w / np.sqrt((w * w).sum()) if len(w) else w)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.int32())), pa.array(weights, pa.list_(pa.float64()))], ["id", "terms", "weights"])

        return texts.select(F.col(id).alias("id"), F.lower(F.col(text)).alias("t")).mapInArrow(weigh, f"id {kind}, terms array<int>, weights array<double>")


def fit_text_model(texts: DataFrame, text: str, features: int = FEATURES, stop_words: Iterable[str] = STOP_WORDS) -> TextModel:
    """Keep the ``features`` commonest terms of some texts, equally common ones in order, with their document frequencies.

    Words are counted first, in each task before they are shuffled. A pair is no commoner
    than either of its words and sorts after its first one, so only pairs that begin with one
    of the ``features`` commonest words and end with one as common as the last of these
    can be kept; the second pass counts no others. A null text is a document without terms.
    """
    stop_words, most = tuple(stop_words), HELD
    no = frozenset(stop_words)
    lowered = texts.select(F.lower(F.col(text)).alias("t"))
    ranked = lambda df, k: df.orderBy(F.desc("n"), "term").limit(k).collect()
    words = ranked(lowered.mapInArrow(lambda b: _words(b, no, most), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")), 2 * features)
    least = words[features - 1]["n"] if features <= len(words) else 0
    left = frozenset(w["term"] for w in words[:features])
    right = frozenset(w["term"] for w in words if w["n"] >= least) if len(words) < 2 * features or words[-1]["n"] < least else None
    counts = lowered.mapInArrow(lambda b: _counted(b, no, left, right, most), "term string, n long, docs long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    seen = {r["term"]: r["docs"] for r in ranked(counts, features)}
    kept, n = sorted(seen), texts.count()
    return TextModel(tuple(kept), tuple(float(np.log((1 + n) / (1 + seen[t])) + 1) for t in kept), n, stop_words)


def _products(batches: Iterator[pa.RecordBatch], basis: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per task: the transposed weights times (weights times basis), a row of it each term that the task has."""
    total = np.zeros_like(basis)
    step = max(BLOCK // max(len(basis), 1), 1)
    for batch in batches:
        for start in range(0, batch.num_rows, step):
            at, w = batch.column(0).slice(start, step), batch.column(1).slice(start, step)
            rows = np.zeros((len(at), len(basis)))
            rows[np.repeat(np.arange(len(at)), pc.list_value_length(at).to_numpy(zero_copy_only=False)), at.flatten().to_numpy(zero_copy_only=False)] = w.flatten().to_numpy(zero_copy_only=False)
            total += rows.T @ (rows @ basis)
    at = np.flatnonzero(total.any(1))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(list(total[at]), pa.list_(pa.float64()))], ["i", "v"])


def _sum(parts: pa.Table) -> pa.Table:
    """The sum of the tasks' rows of one term."""
    rows = parts.column("v").combine_chunks()
    total = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1).sum(0)
    return pa.table({"i": parts.column("i")[:1], "v": pa.array([total], pa.list_(pa.float64()))})


@dataclass(frozen=True)
class LatentModel:
    """Directions in a vocabulary, by falling share of the texts' weights, as columns; ``values`` are the squared singular values."""

    text: TextModel
    directions: np.ndarray
    values: np.ndarray

    def vectors(self, texts: DataFrame, id: str, text: str) -> DataFrame:
        """(id, vector): each text's weights along the directions; zeros for a text without known terms."""
        kind, directions = texts.schema[id].dataType.simpleString(), self.directions

        def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [np.array(w) @ directions[at] if at else np.zeros(directions.shape[1]) for at, w in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["id", "vector"])

        return self.text.weights(texts, id, text).mapInArrow(project, f"id {kind}, vector array<double>")

    def embed(self) -> Embed:
        return lambda rows: self.vectors(rows, "id", "words")


def fit_latent_model(texts: DataFrame, text: str, model: TextModel, components: int = COMPONENTS, tolerance: float = 1e-7, rounds: int = 100) -> LatentModel:
    """Latent semantic directions by distributed subspace iteration.

    A round needs the product of the weights, transposed, with (weights times basis): every
    task multiplies its own rows and Spark adds the tasks' sums. With at most ``GRAM`` terms
    that is done once, for all terms (terms * terms sums), and rounds take no more jobs; with more, the
    weights are written once, and a round brings terms * components sums. The driver holds that
    one matrix, of a size bounded by the vocabulary, and makes it orthonormal. A few spare
    columns speed the rounds, which end when the values move less than ``tolerance``.
    """
    v = len(model.terms)
    rows = model.weights(texts.withColumn("_row", F.lit(0)), "_row", text).select("terms", "weights")

    def product(basis: np.ndarray) -> np.ndarray:
        y = np.zeros((v, basis.shape[1]))
        for r in rows.mapInArrow(lambda b: _products(b, basis), "i int, v array<double>").groupBy("i").applyInArrow(_sum, "i int, v array<double>").collect():
            y[r["i"]] = r["v"]
        return y

    if v > GRAM:
        rows = checkpointed(rows)
    gram = product(np.eye(v)) if 0 < v <= GRAM else None
    components = min(components, v)
    width = min(v, components + 8)
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(v, width)))[0] if v else np.zeros((0, 0))
    values = np.zeros(width)
    for _ in range(rounds if v else 0):
        y = product(basis) if gram is None else gram @ basis
        small, turn = np.linalg.eigh((basis.T @ y + y.T @ basis) / 2)  # Rayleigh-Ritz in the present subspace
        before, values = values, small[::-1]
        directions = basis @ turn[:, ::-1]
        if np.abs(values - before)[:components].max() <= tolerance * max(values[0], 1e-300):
            break
        basis = np.linalg.qr(y)[0]
    keep = values[:components] > 1e-12 * max(values[:1].max(initial=0.0), 1e-300) if v else np.zeros(0, bool)
    directions = directions[:, :components][:, keep] if v else np.zeros((0, 0))
    signs = np.sign(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])]) if directions.size else np.zeros(0)
    return LatentModel(model, directions * signs, np.maximum(values[:components][keep], 0.0))


def search(texts: DataFrame, question: str, embed: Embed, k: int = 10, threshold: float = 0.0) -> DataFrame:
    """(id, score): the k texts (id, words) nearest to a question by cosine, at ``threshold`` or above; ``embed`` makes vectors of both."""
    asked = embed(texts.sparkSession.createDataFrame([("?", question)], "id string, words string")).select(F.col("vector").alias("q"))
    found = embed(texts.select("id", "words")).join(F.broadcast(asked))  # one row
    return found.select("id", F.round(cosine(F.col("vector"), F.col("q")), 6).alias("score")).where(F.col("score") >= threshold).orderBy(F.desc("score"), "id").limit(k)


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts by a model fitted on all documents."""
    model = fit_text_model(table(spark, sf_dir, "documents"), "text")
    rows = model.weights(table(spark, sf_dir, "benchmark"), "item_id", "text")
    terms = F.array(*map(F.lit, model.terms)).cast("array<string>")
    return rows.select("id", F.explode(F.arrays_zip("terms", "weights")).alias("e")).select(F.col("id").alias("item_id"), F.get(terms, F.col("e.terms")).alias("term"), F.round("e.weights", 5).alias("weight"))


def _latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latent vectors of the benchmark's texts, by directions fitted on all documents."""
    docs = table(spark, sf_dir, "documents")
    model = fit_latent_model(docs, "text", fit_text_model(docs, "text"), 16, 1e-5)
    return model.vectors(table(spark, sf_dir, "benchmark"), "item_id", "text").select(F.col("id").alias("item_id"), F.posexplode("vector").alias("component", "value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"fitted_text_weights": _weights, "latent_text_vectors": _latent}


def oracle_sql() -> dict[str, str]:
    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    words = lambda t, i: f"SELECT {i} AS id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '([\\p{{L}}\\p{{N}}_]{{2,}})', 1), lambda w: w NOT IN ({stop})) AS w FROM {t}"
    terms = lambda t, i: f"SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]))) AS term FROM ({words(t, i)}) q"
    return {
        "fitted_text_weights": f"WITH d AS ({terms('documents', 'doc_id')}), v AS (SELECT term FROM d GROUP BY term ORDER BY count(*) DESC, term LIMIT {FEATURES}), f AS (SELECT term, count(DISTINCT id) AS df FROM d WHERE term IN (SELECT term FROM v) GROUP BY term), b AS (SELECT id, term, count(*) AS tf FROM ({terms('benchmark', 'item_id')}) q GROUP BY id, term), x AS (SELECT id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS z FROM b JOIN f USING (term)), n AS (SELECT id, sqrt(sum(z * z)) AS norm FROM x GROUP BY id) SELECT id AS item_id, term, round(z / norm, 5) AS weight FROM x JOIN n USING (id)"
    }
