"""Quality rules: repetition and length, then divergence from language references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import fresh_name, written

SPACE = r"[\x20\x09-\x0D]+"
# Frequent function words of each language.
COMMON_WORDS = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "for", "on", "with", "was"],
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "ist", "für", "nicht", "ein"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "une", "que", "dans", "qui"],
    "es": ["de", "la", "que", "el", "en", "y", "los", "se", "del", "las", "un", "por"],
}
BINS = 12
# Character classes counted by pattern; white space and all other characters are the last two.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "punct": "[.,;:!?]", "symbol": r"[#*$%&|<>]", "wide": r"[^\x00-\x7F]"}
MIN_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 50, 0.3, 0.3


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(words: Column, width: int = 5) -> Column:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""

    def covered(grams: Column) -> Column:
        def starts(order: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(order, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(order, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        order = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        total = F.aggregate(
            _let(order, starts), zero,
            lambda acc, i: F.struct((acc["n"] + i + width - F.greatest(i, acc["end"])).cast("int").alias("n"), (i + width).cast("int").alias("end")),
            lambda acc: acc["n"],
        )
        return F.when(F.size(F.array_distinct(grams)) == F.size(grams), 0).otherwise(total)

    grams = F.transform(F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(0))), lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, width)]))
    return _let(grams, covered).cast("long")


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", carry: bool = False) -> DataFrame:
    """Counts of one document: the rules' inputs and the histograms of character classes and common words; with ``carry`` also its row."""
    own = ["row"] if carry else []
    base = docs.select(*[F.struct(*docs.columns).alias(x) for x in own], docs[doc_id].alias("doc_id"), docs[lang].alias("lang"), F.coalesce(docs[text], F.lit("")).alias("t"))
    base = base.withColumn("words", F.array_remove(F.split("t", SPACE), ""))
    words, t = F.col("words"), F.col("t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    common = F.lit(None).cast("array<string>")
    for key, values in COMMON_WORDS.items():
        common = F.when(F.col("lang") == key, F.array(*map(F.lit, values))).otherwise(common)
    common = F.coalesce(common, F.array().cast("array<string>"))
    hits = _let(common, lambda known: F.filter(F.transform(words, lambda w: F.array_position(known, F.lower(w))), lambda k: k > 0))
    counted = base.select(
        *own, "doc_id", "lang", F.size(words).cast("long").alias("n_words"), F.length(t).cast("long").alias("n_all"),
        F.length(F.regexp_replace(t, SPACE, "")).cast("long").alias("word_chars"),
        *[F.regexp_count(t, F.lit(p)).cast("long").alias(f"n_{k}") for k, p in CLASSES.items()],
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeated_words(words).alias("n_repeat_words"),
        _let(hits, lambda h: F.transform(F.sequence(F.lit(1), F.lit(BINS)), lambda b: F.size(F.filter(h, lambda k: k == b)).cast("long"))).alias("hits"),
    )
    named = [F.col(f"n_{k}") for k in CLASSES]
    spaces = F.col("n_all") - F.col("word_chars")
    return counted.select(
        *own, "doc_id", "lang", "n_words", "word_chars", F.col("n_symbol").alias("n_symbols"), "n_dup_lines", "n_repeat_words",
        F.array(*named, spaces, F.col("n_all") - spaces - sum(named[1:], named[0])).alias("chars"),
        F.concat("hits", F.array(F.col("n_words") - F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x))).alias("common"),
    )


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance (base 2) of two histograms of counts; 0 if either is empty."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    plogp = lambda x: F.when(x > 0, x * F.log2(x)).otherwise(0.0)
    share = lambda a: _let(total(a), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(0.0)))

    def divergence(pair: Column) -> Column:
        return F.aggregate(F.zip_with(pair["p"], pair["q"], lambda a, b: (plogp(a) + plogp(b)) / 2 - plogp((a + b) / 2)), F.lit(0.0), lambda s, x: s + x)

    ready = (total(p) > 0) & (total(q) > 0)
    return F.when(ready, F.sqrt(F.greatest(_let(F.struct(share(p).alias("p"), share(q).alias("q")), divergence), F.lit(0.0)))).otherwise(0.0)


def _judged(rows: DataFrame, min_words: int, max_char: float, max_word: float) -> DataFrame:
    """The features with base_failed, kept and both distances.

    References are sums of fixed-length arrays, bin by bin, so partial sums leave each
    task. They are written, so that Spark knows their size and broadcasts them only
    if that is small.
    """
    rows = rows.withColumn("key", F.coalesce("lang", F.lit("")))
    width = len(CLASSES) + 2
    sums = rows.groupBy("key").agg(*[F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(width)], *[F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(BINS + 1)])
    reference = written(sums.select("key", F.array(*[f"c{i}" for i in range(width)]).alias("ref_chars"), F.array(*[f"w{i}" for i in range(BINS + 1)]).alias("ref_common")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    far = (F.col("char_distance") > max_char) | (F.col("word_distance") > max_word)
    return (
        rows.join(reference, "key", "left")
        .withColumn("char_distance", F.round(js_distance(F.col("chars"), F.col("ref_chars")), 6))
        .withColumn("word_distance", F.round(js_distance(F.col("common"), F.col("ref_common")), 6))
        .withColumns({"base_failed": failed, "kept": ~failed & ((F.col("n_words") < min_words) | ~far)})
    )


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", min_words: int = MIN_WORDS, max_char: float = MAX_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE) -> DataFrame:
    """Judge every document; one row each, repeated rows included.

    base_failed: fewer than 10 words, or over a fifth of the words in windows of
    five that repeat. Otherwise a document of at least ``min_words`` words is
    dropped when its histogram of character classes, or of its language's common
    words, is further from the language's reference (the sum over all documents
    of that language) than the limits allow. Shorter documents are kept: their
    histograms say little. A null text has no words; a null or unknown language has
    a reference of its own and no common words. A null doc_id is kept as it is; other columns are ignored.
    """
    judged = _judged(written(features(docs, doc_id, text, lang)), min_words, max_char, max_word)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that ``quality_rules`` keeps, with all their columns; each by its own verdict, repeated rows and null ids included.

    A row is written once beside its counts and never shuffled.
    """
    none = fresh_name(docs.columns, "_none")
    rows = written(features(docs.withColumn(none, F.lit(None).cast("long")), none, text, lang, carry=True))
    return _judged(rows, MIN_WORDS, MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE).where("kept").select("row.*").select(*docs.columns)


def _sql() -> str:
    common = "CASE lang " + " ".join("WHEN '{}' THEN [{}]".format(k, ", ".join(f"'{w}'" for w in v)) for k, v in COMMON_WORDS.items()) + " ELSE [] END"
    classes = ", ".join(f"len(regexp_extract_all(t, '{p}'))" for p in CLASSES.values())
    names = [f"k{i}" for i in range(len(CLASSES))]
    dist = lambda p, q: f"round(sqrt(greatest(list_sum(list_transform(list_zip({p}, {q}), lambda x: (CASE WHEN x[1] > 0 THEN x[1] * log2(x[1]) ELSE 0 END + CASE WHEN x[2] > 0 THEN x[2] * log2(x[2]) ELSE 0 END) / 2 - CASE WHEN x[1] + x[2] > 0 THEN (x[1] + x[2]) / 2 * log2((x[1] + x[2]) / 2) ELSE 0 END)), 0)), 6)"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
g AS (SELECT doc_id, i, words[i:i + 4] AS gram FROM w, unnest(range(1, len(words) - 3)) AS u(i)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g), range(5) AS o(k) WHERE c > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
c AS (SELECT doc_id, coalesce(lang, '') AS key, len(words) AS n_words, length(t) AS n_all, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  [{classes}] AS k, {common} AS known, list_transform(words, lambda x: lower(x)) AS low FROM w),
h AS (SELECT *, list_concat(k, [n_all - word_chars, word_chars - list_sum(k)]) AS chars, list_transform(range(1, {BINS + 1}), lambda b: len(list_filter(low, lambda x: x = known[b]))) AS hits FROM c),
f AS (SELECT *, list_concat(hits, [n_words - list_sum(hits)]) AS common FROM h),
s AS (SELECT key, [{", ".join(f"sum(chars[{i + 1}])" for i in range(len(CLASSES) + 2))}] AS rc, [{", ".join(f"sum(common[{i + 1}])" for i in range(BINS + 1))}] AS rw FROM f GROUP BY key),
p AS (SELECT f.*, CASE WHEN n_all > 0 THEN list_transform(chars, lambda x: x / n_all) END AS pc, list_transform(rc, lambda x: x / list_sum(rc)) AS qc, CASE WHEN n_words > 0 THEN list_transform(common, lambda x: x / n_words) END AS pw, list_transform(rw, lambda x: x / list_sum(rw)) AS qw FROM f JOIN s USING (key)),
v AS (SELECT p.*, coalesce(n_dup_lines, 0) AS dup, coalesce(n_repeat_words, 0) AS rep, coalesce({dist("pc", "qc")}, 0) AS char_distance, coalesce({dist("pw", "qw")}, 0) AS word_distance FROM p LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(k[{list(CLASSES).index("symbol") + 1}] AS BIGINT) AS n_symbols, CAST(dup AS BIGINT) AS n_dup_lines, CAST(rep AS BIGINT) AS n_repeat_words,
  n_words < 10 OR 100 * rep > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * rep > 20 * n_words) AND (n_words < {MIN_WORDS} OR NOT (char_distance > {MAX_CHAR_DISTANCE} OR word_distance > {MAX_WORD_DISTANCE})) AS kept, char_distance, word_distance
FROM v"""


SQL = _sql()
