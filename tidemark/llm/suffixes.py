"""Removal of repeated passages: byte strings that also start earlier in the corpus.

Equal windows of ``length`` bytes have equal minimizers, so every repeat lies between two
runs of the same minimizer. Whole copies of a text are known by their digest, runs whose
minimizer occurs once are left out, and equal runs of one minimizer meet as one. The
different runs of a minimizer are dealt by it, and in each share their suffixes are
compared through merged Burrows-Wheeler transforms of its shards. Minimizers of more than
``HOT`` different runs are dealt further, by the content of their windows.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bwt import repeats
from tidemark.llm.chunks import slices
from tidemark.llm.shared import discard, fresh_name, written
from tidemark.llm.windows import gram_hashes, runs

GRAM = 32  # bytes a minimizer hashes
ROWS_A_SHARE = 1000
HOT = 1000  # a minimizer with more runs than these is compared window by window
BROADCAST = 1 << 20  # hot minimizers (8 MB) that every task may get as one array; more of them are joined to the documents
SALTS = 32  # parts that the documents of one hot minimizer are dealt into by that join
_PENDING = 1 << 19  # windows of such minimizers that a task holds at once
_EMPTY = hashlib.sha256(b"").hexdigest()


def _repeated_minimizers(docs: DataFrame, length: int, shares: int) -> DataFrame:
    """(doc_id, found): the document's minimizers that occur in another run too.

    Each task sends its distinct minimizers, as arrays by range of hash. One that repeats
    inside the task is credited there and sent once, without owner, so that copies and
    common passages do not pile up.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(slices(batches)):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            names, owners, multis = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for key, text in zip(ids, batch.column(1)):
                found, _, _, multi = runs(np.frombuffer((text.as_py() or "").encode(), np.uint8), length, GRAM)
                names.append(found)
                owners.append(np.full(len(found), key))
                multis.append(multi)
            name, owner, multi = np.concatenate(names), np.concatenate(owners), np.concatenate(multis)
            order = np.argsort(name, kind="stable")
            name, owner, multi = name[order], owner[order], multi[order]
            same = np.zeros(len(name) + 1, bool)
            same[1:-1] = name[1:] == name[:-1]
            repeated, first = same[1:] | same[:-1] | multi, ~same[:-1]
            sent, sender, known = name[first], owner[first], repeated[first]
            part = (sent >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(shares + 1, dtype=np.uint64))
            # What is known to repeat has no owner: its occurrences here are credited below.
            rows = []
            for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if b > a:
                    lone = ~known[a:b]
                    rows.append((r, np.concatenate([sent[a:b][lone], sent[a:b][~lone]]).tobytes(), sender[a:b][lone].tobytes(), False))
            rows.append(((TaskContext.get().partitionId() * 31 + number) % shares, name[repeated].tobytes(), owner[repeated].tobytes(), True))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.bool_()))], ["part", "names", "owners", "known"])

    def match(table: pa.Table) -> pa.Table:
        names, owners, done_names, done_owners = [], [], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for n, o, known in zip(*(table.column(k).to_pylist() for k in ("names", "owners", "known"))):
            name, owner = np.frombuffer(n, np.uint64), np.frombuffer(o, np.int64)
            if known:
                done_names.append(name)
                done_owners.append(owner)
            else:
                names.append(name)
                owners.append((owner, len(name)))
        if names:
            name = np.concatenate(names)
            owned = np.concatenate([np.arange(n) < len(o) for o, n in owners])
            owner = np.zeros(len(name), np.int64)
            owner[owned] = np.concatenate([o for o, _ in owners])
            order = np.argsort(name, kind="stable")
            name, owner, owned = name[order], owner[order], owned[order]
            same = np.zeros(len(name) + 1, bool)
            same[1:-1] = name[1:] == name[:-1]
            hit = (same[1:] | same[:-1]) & owned
            done_names.append(name[hit])
            done_owners.append(owner[hit])
        name, owner = np.concatenate(done_names), np.concatenate(done_owners)
        order = np.argsort(owner, kind="stable")
        name, owner = name[order], owner[order]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(name)), pa.int32()), pa.array(name.view(np.int64)))
        return pa.table({"doc_id": owner[first], "found": lists})

    sent = docs.mapInArrow(send, "part int, names binary, owners binary, known boolean")
    credited = sent.groupBy("part").applyInArrow(match, "doc_id long, found array<bigint>")
    return credited.groupBy("doc_id").agg(F.flatten(F.collect_list("found")).alias("found"))


def _hot_minimizers(held: DataFrame, length: int) -> DataFrame:
    """(name): the minimizers with more than ``HOT`` runs, of which a task counts equal ones once: at most a ``HOT``-th of all runs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            seen: set[tuple[int, int]] = set()
            for text, found in zip(batch.column(1), batch.column(2)):
                raw = text.as_py().encode()
                name, start, number, _ = runs(np.frombuffer(raw, np.uint8), length, GRAM)
                wanted = np.isin(name, found.values.to_numpy().view(np.uint64))
                seen.update((m, hash(raw[s : s + c + length - 1])) for m, s, c in zip(name[wanted].view(np.int64).tolist(), start[wanted].tolist(), number[wanted].tolist()))
            names, counts = np.unique(np.array([m for m, _ in seen], np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(counts.astype(np.int64))], ["name", "n"])

    counted = held.select("doc_id", "text", "found").mapInArrow(count, "name long, n long").groupBy("name").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") > HOT).select("name")


def _marked(held: DataFrame, hot: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """``held`` with ``often``, and an array: the hot minimizers are in the array if they are few, else each document's own in ``often``."""
    none = F.array().cast("array<bigint>")
    if hot.count() <= BROADCAST:
        return held.withColumn("often", none), np.array([r["name"] for r in hot.collect()], np.int64)
    names = held.select("doc_id", F.explode("found").alias("name")).withColumn("salt", F.pmod("doc_id", F.lit(SALTS)))
    salted = hot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    often = names.join(salted, ["name", "salt"], "left_semi").groupBy("doc_id").agg(F.collect_set("name").alias("often"))
    return held.join(often, "doc_id", "left").withColumn("often", F.coalesce("often", none)), np.zeros(0, np.int64)


def _windows(raw: bytes, starts: np.ndarray, counts: np.ndarray, key: int, length: int) -> np.ndarray:
    """Columns of the windows of some runs: two hashes of their bytes, doc_id and start."""
    half, data = length // 2, np.frombuffer(raw, np.uint8)
    at = np.concatenate([np.arange(s, s + c) for s, c in zip(starts.tolist(), counts.tolist())])
    return np.stack([gram_hashes(data, half)[at].view(np.int64), gram_hashes(data, length - half)[at + half].view(np.int64), np.full(len(at), key, np.int64), at.astype(np.int64)])


def _later(windows: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The earliest of each group of equal windows, and runs (doc_id, start, count) of the other ones."""
    windows = windows[:, np.lexsort(windows[::-1])]
    opens = np.ones(windows.shape[1], bool)
    opens[1:] = (windows[:2, 1:] != windows[:2, :-1]).any(0)
    first = windows[:, opens]
    again = windows[2:, (windows[2:] != first[2:, np.cumsum(opens) - 1]).any(0)]
    again = again[:, np.lexsort(again[::-1])]
    starts = np.ones(again.shape[1], bool)
    starts[1:] = (again[0, 1:] != again[0, :-1]) | (again[1, 1:] > again[1, :-1] + 1)
    at = np.flatnonzero(starts)
    ends = np.append(at[1:], again.shape[1]) - 1
    return first, list(zip(again[0, at].tolist(), again[1, at].tolist(), (again[1, ends] - again[1, at] + 1).tolist())) if len(at) else []


def _removed_runs(held: DataFrame, hot: DataFrame, length: int, shares: int) -> DataFrame:
    """(doc_id, start, count): runs of window starts whose window also starts earlier.

    A task sends each distinct run of windows once, with its bytes, and reports later
    occurrences of the same run right away. Runs of hot minimizers are not compared with
    each other: their windows are dealt by two hashes of their own bytes, as arrays, each
    distinct one once a task, so that no share holds all runs around a common passage.
    """
    marked, few = _marked(held, hot)
    shared = held.sparkSession.sparkContext.broadcast(few)

    def deal(windows: list[np.ndarray], rows: list[tuple]) -> None:
        first, again = _later(np.concatenate(windows, 1))
        part = ((first[0].view(np.uint64) >> np.uint64(32)) * np.uint64(shares) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        first, part = first[:, order], part[order]
        at = np.flatnonzero(np.diff(part, prepend=-1))
        rows += [(int(part[a]), None, 0, 0, 0, first[:, a:b].tobytes(), False) for a, b in zip(at.tolist(), [*at[1:].tolist(), len(part)])]
        rows += [(hash((k, s)) % shares, 0, k, s, c, None, False) for k, s, c in again]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everywhere = shared.value
        for batch in slices(batches):
            first: dict[tuple[int, bytes], tuple[int, int]] = {}
            again: list[tuple[int, int, int, int]] = []
            several: set[int] = set()
            rows: list[tuple] = []
            windows: list[np.ndarray] = []
            for key, text, found, here in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3)):
                raw = text.as_py().encode()
                often = everywhere if len(everywhere) else here.values.to_numpy()
                name, start, count, multi = runs(np.frombuffer(raw, np.uint8), length, GRAM)
                wanted = np.isin(name, found.values.to_numpy().view(np.uint64))
                if len(often):
                    common = wanted & np.isin(name.view(np.int64), often)
                    if common.any():
                        windows.append(_windows(raw, start[common], count[common], key, length))
                        if sum(w.shape[1] for w in windows) > _PENDING:
                            deal(windows, rows)
                            windows.clear()
                        wanted &= ~common
                several.update(name[wanted & multi].view(np.int64).tolist())
                for m, s, c in zip(name[wanted].view(np.int64).tolist(), start[wanted].tolist(), count[wanted].tolist()):
                    body = raw[s : s + c + length - 1]
                    seen = first.setdefault((m, body), (key, s))
                    if seen != (key, s):
                        if (key, s) < seen:
                            first[m, body], seen = (key, s), seen
                            again.append((m, *seen, c))
                        else:
                            again.append((m, key, s, c))
            if windows:
                deal(windows, rows)
            rows += [(m % shares, m, k, s, None, body, m in several) for (m, body), (k, s) in first.items()]
            rows += [(hash((k, s)) % shares, m, k, s, c, None, False) for m, k, s, c in again]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.bool_()))], ["part", "name", "doc_id", "start", "count", "body", "multi"])

    def compare(table: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        first: dict[tuple[int, bytes], tuple[int, int]] = {}
        names: dict[int, int] = {}
        several: set[int] = set()
        windows: list[np.ndarray] = []
        for name, key, start, count, body, multi in zip(*(table.column(k).to_pylist() for k in ("name", "doc_id", "start", "count", "body", "multi"))):
            if name is None:
                windows.append(np.frombuffer(body, np.int64).reshape(4, -1))
                continue
            if multi:
                several.add(name)
            if body is None:
                out.append((key, start, count))
                continue
            seen = first.get((name, body))
            if seen is None:
                first[name, body] = (key, start)
                names[name] = names.get(name, 0) + 1
            elif seen != (key, start):
                low, high = sorted([seen, (key, start)])
                first[name, body] = low
                out.append((*high, len(body) - length + 1))
        if windows:
            out += _later(np.concatenate(windows, 1))[1]
        # A run alone under its minimizer can only repeat within itself, and only if that lies in it twice.
        rows = sorted((k, s, body) for (name, body), (k, s) in first.items() if names[name] > 1 or name in several)
        if rows:
            for (key, start, _), flags in zip(rows, repeats([r[2] for r in rows], length)):
                edges = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
                out += [(key, start + a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist())]
        return pa.table({k: pa.array([r[i] for r in out], pa.int64()) for i, k in enumerate(("doc_id", "start", "count"))})

    sent = marked.select("doc_id", "text", "found", "often").mapInArrow(send, "part int, name long, doc_id long, start long, count long, body binary, multi boolean")
    return sent.groupBy("part").applyInArrow(compare, "doc_id long, start long, count long")


def _judged(docs: DataFrame, length: int) -> DataFrame:
    """The columns of ``remove_repeats`` and sha, the digest of the text, of every pair of doc_id and text."""
    base = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("sha"))
    base = written(base)
    if not base.groupBy("doc_id").count().where("count > 1").limit(1).count():
        found = _judged_by_key(docs, base, length)
        discard(base)
        return found
    # Each pair gets a key of its own, in the order of doc_id, so that rows of one doc_id do not mix.
    keys = written(base.distinct().orderBy("doc_id", "sha").withColumn("key", F.monotonically_increasing_id()))
    discard(base)
    texts = docs.withColumn("sha", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).dropDuplicates(["doc_id", "sha"])
    texts = written(texts.join(keys, ["doc_id", "sha"]).select(F.col("key").alias("doc_id"), "text"))
    found = _judged_by_key(texts, keys.select(F.col("key").alias("doc_id"), "n_bytes", "sha"), length)
    discard(texts)
    return found.withColumnRenamed("doc_id", "key").join(keys.select("key", "doc_id"), "key").select("doc_id", *[c for c in found.columns if c != "doc_id"])


def remove_repeats(docs: DataFrame, length: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans of every document.

    A byte of the UTF-8 text goes when a string of ``length`` bytes that covers it also
    starts earlier: in a document of smaller doc_id, or before in the same one. All
    strings are judged on the input. spans lists the removed ranges (start, end in
    bytes), null for a whole copy of an earlier text. A null text is empty; shorter
    texts than ``length`` lose nothing. A row with a null doc_id
    is not compared and loses nothing. Repeated rows of a doc_id and a text give one row; several texts of
    one doc_id are taken in the order of their digests. Other columns are ignored.
    """
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    own, none = F.coalesce("text", F.lit("")), F.lit(0).cast("long")
    nameless = docs.where(F.col("doc_id").isNull()).select(
        "doc_id", F.octet_length(own).cast("long").alias("n_bytes"), none.alias("n_removed"), F.lit(0).alias("n_spans"),
        F.sha2(own.cast("binary"), 256).alias("kept_sha256"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"),
    )
    judged = _judged(docs.where(F.col("doc_id").isNotNull()), length).drop("sha")
    return judged.unionByName(nameless.withColumn("n_spans", F.col("n_spans").cast(judged.schema["n_spans"].dataType)))


def _judged_by_key(docs: DataFrame, base: DataFrame, length: int) -> DataFrame:
    """As ``_judged``, for a doc_id that no two rows share and a base of its sizes and digests."""
    shares = max(256, docs.count() // ROWS_A_SHARE)
    # The earliest row of each text is found by its doc_id, not its digest, which a third of the rows may share.
    earliest = base.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("first"))
    base = written(base.join(earliest, "doc_id", "left").withColumn("copy", F.col("first").isNull() & (F.col("n_bytes") >= length)).drop("first"))

    found = _repeated_minimizers(docs, length, shares).join(base.where("copy").select("doc_id"), "doc_id", "left_anti")
    held = written(docs.join(found.hint("shuffle_hash"), "doc_id"))
    hot = written(_hot_minimizers(held, length))
    starts = _removed_runs(held, hot, length, shares).groupBy("doc_id").agg(F.collect_list(F.struct("start", "count")).alias("runs"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, spans = [], []
            for body, found in zip(batch.column(1), batch.column(2).to_pylist()):
                raw = body.as_py().encode()
                gone: list[list[int]] = []
                for a, b in sorted((r["start"], r["start"] + r["count"] + length - 1) for r in found):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(b, gone[-1][1])
                    else:
                        gone.append([a, b])
                digest, at = hashlib.sha256(), 0
                for a, b in gone:
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                kept.append(digest.hexdigest())
                spans.append([{"start": a, "end": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "kept", "spans"])

    cuts = held.select("doc_id", "text").join(starts.hint("shuffle_hash"), "doc_id").mapInArrow(apply, "doc_id long, kept string, spans array<struct<start: bigint, end: bigint>>")
    cuts = written(cuts)
    discard(held, hot)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return base.join(cuts, "doc_id", "left").select(
        "doc_id", "n_bytes",
        F.when(F.col("copy"), F.col("n_bytes")).otherwise(F.coalesce(removed, F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), 1).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("copy"), _EMPTY).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(~F.col("copy"), F.coalesce("spans", F.array().cast("array<struct<start: bigint, end: bigint>>"))).alias("spans"), "sha",
    )


def cut_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """The documents (doc_id, text and n_chars, with any other columns) without their repeated passages; n_chars follows the text.

    A character goes when all its bytes do. Documents of which nothing is left, as
    whole copies, go; texts that were empty or null before stay. All columns are kept;
    of repeated rows of a doc_id and a text one stays; rows with a null doc_id stay as they are.
    """

    def without(text: str, gone: list[dict]) -> str:
        raw, kept, at = text.encode(), [], 0
        for s in gone:
            a, b = s["start"], s["end"]
            while a < len(raw) and raw[a] & 0xC0 == 0x80:
                a += 1
            while b < len(raw) and raw[b] & 0xC0 == 0x80:
                b -= 1
            if b > a:
                kept.append(raw[at:a])
                at = b
        return b"".join([*kept, raw[at:]]).decode()

    names = docs.columns
    place = {name: i for i, name in enumerate(names)}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One operator cuts, counts and filters, so that a task needs one worker.
        for batch in slices(batches, 1000):
            columns = [batch.column(i) for i in range(len(names))]
            spans = batch.column(len(names)).to_pylist()
            texts = [without(t.as_py(), gone) if gone else t.as_py() for t, gone in zip(columns[place["text"]], spans)]
            sizes = [len(t) if gone else n.as_py() for t, gone, n in zip(texts, spans, columns[place["n_chars"]])]
            for name, values in (("text", texts), ("n_chars", sizes)):
                columns[place[name]] = pa.array(values, columns[place[name]].type)
            rest = pa.array([not gone or t != "" for t, gone in zip(texts, spans)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, names).filter(rest)

    id_, sha, spans_ = (fresh_name(names, n) for n in ("_id", "_sha", "_spans"))
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).where(F.col("doc_id").isNotNull())
    found = _judged(keyed, length).where("n_removed > 0 and n_removed < n_bytes or n_removed = 0").select(F.col("doc_id").alias(id_), F.col("sha").alias(sha), F.col("spans").alias(spans_))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    joined = docs.join(found, (F.col("doc_id") == F.col(id_)) & (digest == F.col(sha))).dropDuplicates([id_, sha])
    return joined.select(*names, spans_).mapInArrow(cut, docs.schema).union(docs.where(docs["doc_id"].isNull()))
