"""Exact Jaccard join of shingle sets by token-combination prefixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.chunks import slices
from tidemark.llm.components import connected_components
from tidemark.llm.shared import discard, join_by_class, written
from tidemark.llm.shingles import shingles

RARE = 8  # a token in more sets than these is frequent
GROUPS = 16  # classes of frequent tokens, of which pairs are indexed; long sets have more
BLOCK = 2000  # sets of a bucket that one task compares with the bucket
ROWS_A_RANGE = 1500
WORDS = 16  # 64-bit words of a set's parity map


def _needed(n, percent: int):
    """The least overlap of a set of n shingles with a similar one."""
    return -(-n * percent // 100)


def _extra(n):
    """Tokens by which the first prefix is extended; grows with n."""
    return n * 3 // 10


def _classes(n: int) -> int:
    """The classes of a set of n tokens: a power of two, about n / 30, so that a class holds a bounded part of the prefix."""
    return max(GROUPS, 1 << (n // 40).bit_length())


def _suspects(docs: DataFrame, width: int, percent: int, ranges: int) -> DataFrame:
    """(doc_id, n, near): size of each document's set and whether it can have a link at all.

    In the order of their hashes, two similar sets share more than ``_extra`` tokens
    among their extended prefixes. So each task sends the prefixes' distinct tokens, as
    arrays by range of hash; a token found in two places credits its documents. A token
    that repeats inside a task credits its documents there and is sent once, without
    owner, so that copies do not pile up. Hashes are shortened here: a collision can
    only add suspects.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, batch in enumerate(slices(batches)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            sets = shingles(batch.column(1), width)
            n = np.array([len(s) for s in sets], np.int64)
            take = np.minimum(n, n - _needed(n, percent) + 1 + _extra(n))
            tokens = np.concatenate([np.zeros(0, np.uint64), *[s[:k] for s, k in zip(sets, take)]])
            owner = np.repeat(np.arange(len(ids)), take)
            order = np.argsort(tokens, kind="stable")
            tokens, owner = tokens[order], owner[order]
            same = np.zeros(len(tokens) + 1, bool)
            same[1:-1] = tokens[1:] == tokens[:-1]
            repeated = same[1:] | same[:-1]
            credit = np.bincount(owner[repeated], minlength=len(ids))
            first = ~same[:-1]
            tokens, sender, known = tokens[first], ids[owner][first].astype(np.int64), repeated[first]
            part = (tokens >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
            cuts = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
            short = (tokens * np.uint64(ranges) >> np.uint64(32)).astype(np.uint32)  # the bits below the range
            rows = []
            for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                if b > a:  # tokens with an owner come first
                    lone = ~known[a:b]
                    rows.append((r, np.concatenate([short[a:b][lone], short[a:b][~lone]]).tobytes(), sender[a:b][lone].tobytes(), None))
            rows.append(((TaskContext.get().partitionId() * 31 + number) % ranges, ids.astype(np.int64).tobytes(), n.tobytes(), credit.astype(np.int64).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "tokens", "owners", "credit"])

    def credit(table: pa.Table) -> pa.Table:
        ids, sizes, credits = [], [], []
        tokens, owners, owned = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for t, o, c in zip(*(table.column(k).to_pylist() for k in ("tokens", "owners", "credit"))):
            if c is None:
                tokens.append(np.frombuffer(t, np.uint32))
                of = np.frombuffer(o, np.int64)
                owners.append(np.append(of, np.zeros(len(tokens[-1]) - len(of), np.int64)))
                owned.append(np.arange(len(tokens[-1])) < len(of))
            else:
                ids.append(np.frombuffer(t, np.int64))
                sizes.append(np.frombuffer(o, np.int64))
                credits.append(np.frombuffer(c, np.int64))
        t, o, lone = np.concatenate(tokens), np.concatenate(owners), np.concatenate(owned)
        order = np.argsort(t, kind="stable")
        t, o, lone = t[order], o[order], lone[order]
        same = np.zeros(len(t) + 1, bool)
        same[1:-1] = t[1:] == t[:-1]
        found, counts = np.unique(o[(same[1:] | same[:-1]) & lone], return_counts=True)
        return pa.table({"doc_id": np.concatenate([*ids, found]).astype(np.int64), "n": np.concatenate([*sizes, np.zeros(len(found), np.int64)]).astype(np.int64), "credit": np.concatenate([*credits, counts]).astype(np.int64)})

    sent = docs.mapInArrow(send, "part int, tokens binary, owners binary, credit binary")
    counted = sent.groupBy("part").applyInArrow(credit, "doc_id long, n long, credit long")
    totals = counted.groupBy("doc_id").agg(F.max("n").alias("n"), F.sum("credit").alias("credit"))
    least = F.floor(F.ceil(F.col("n") * percent / 100) * 3 / 10) + 1
    return totals.select("doc_id", "n", ((F.col("n") > 0) & (F.col("credit") >= least)).alias("near"))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, digest of the set, the set as a sorted array, and its parity map.

    A bit of the parity map tells whether an odd number of tokens fall on it, so two
    maps differ in no more bits than the sets in tokens.
    """

    def parity(tokens: np.ndarray) -> np.ndarray:
        odd = np.bincount((tokens & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1000):
            sets = shingles(part.column(1), width)
            bits = [parity(s) for s in sets]
            found = [s.view(np.int64) for s in sets]
            digest = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in found]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array(digest, pa.binary()), pa.array(found, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], ["doc_id", "n", "digest", "tokens", "bits"])

    return docs.mapInArrow(run, "doc_id long, n long, digest binary, tokens array<bigint>, bits array<bigint>")


def _prefix_signatures(ordered: DataFrame, percent: int) -> DataFrame:
    """(signature, doc_id, n) of the prefixes of sets whose tokens come with their frequency, rarest first.

    Rare tokens are signatures by themselves. Frequent ones fall into classes by hash;
    each class adds a token to the prefix and gives its pairs as signatures: two sets
    that share no signature share at most one token of each class, and so too few.
    A set can run out of tokens before its prefix is whole only if the least overlap is
    no more than the classes; such a set, and any that is similar to it by so few tokens,
    also gives its plain prefix, token by token. The classes grow with the set, so that
    the pairs of a class do not: signatures are about as many as tokens. A set also
    gives those of the largest set that can be similar to it, so two similar sets share a number of classes.
    """

    def signatures(n: int, left: int, tokens: list[int], counts: list[int], groups: int) -> set[int]:
        budget = left
        rare = sum(c <= RARE for c in counts)
        own = set([t for t, c in zip(tokens, counts) if c > RARE][: max(0, budget - rare)]) if _needed(n, percent) <= groups else set()
        classes: dict[int, list[int]] = {}
        for token, count in zip(tokens, counts):
            if budget <= 0:
                break
            if count <= RARE:
                own.add(token)
                budget -= 1
            else:
                group = classes.setdefault(token % groups, [])
                budget -= bool(group)
                group.append(token)
        own.update(hash(pair) for g in classes.values() for pair in combinations(sorted(g), 2))
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sigs, ids, sizes = [], [], []
            for doc, n, tokens, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                t, c = tokens.values.to_numpy(), counts.values.to_numpy()
                order = np.lexsort((t, c))
                t, c = t[order], c[order]
                left = n - _needed(n, percent) + 1 - (n - len(t))  # tokens that no other set has come first and have no signature
                reach = max(0, left) + 2 * _classes(n)  # no prefix goes further
                t, c = t[:reach].tolist(), c[:reach].tolist()
                own = set().union(*(signatures(n, left, t, c, g) for g in {_classes(n), _classes(n * 100 // percent)}))
                sigs += own
                ids += [doc] * len(own)
                sizes += [n] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (sigs, ids, sizes)], ["sig", "doc_id", "n"])

    return ordered.mapInArrow(run, "sig long, doc_id long, n long")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    of = lambda x: sets.select(F.col("doc_id").alias(x), F.col("tokens").alias(f"t{x}"))
    shared = F.size(F.array_intersect("ta", "tb"))
    joined = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b").withColumn("shared", shared)
    return joined.where(100 * F.col("shared") >= percent * (F.size("ta") + F.size("tb") - F.col("shared"))).select("a", "b")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    Two documents link when their shingle sets' Jaccard similarity is ``percent`` or
    more; a component is named after its smallest doc_id. Every link between different
    sets is found. Equal sets are one class from the start; copies are never paired
    with each other. A null or wordless text has no shingles and no link. doc_id is
    taken as a key: rows with a null one are left out, repeated ones give one row, with
    the largest set and the smallest component of its texts if they differ.
    Other columns are ignored.

    Candidates come from prefix signatures. Each bucket first compares its sets with
    one of them; then only sets of the bucket that are still in different components
    and whose parity maps allow a link are paired, so that a large group of near copies costs about one comparison a set.
    """
    docs = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).where(F.col("doc_id").isNotNull())
    total = docs.count()
    ranges = max(256, total // ROWS_A_RANGE)
    sizes = written(_suspects(docs, width, percent, ranges))
    near = sizes.where("near").select("doc_id")
    every = written(_sets(docs.join(near.hint("shuffle_hash"), "doc_id", "left_semi"), width))
    classes = written(every.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("count")))
    sets = written(every.join(classes.select("rep"), F.col("doc_id") == F.col("rep"), "left_semi").select("doc_id", "n", "tokens", "bits"))

    tokens = sets.select("doc_id", "n", F.explode("tokens").alias("token"))
    frequent = tokens.groupBy("token").agg(F.count("*").alias("count")).where("count > 1")
    ordered = tokens.join(frequent, "token").groupBy("doc_id").agg(F.first("n").alias("n"), F.collect_list("token").alias("tokens"), F.collect_list("count").alias("counts"))
    signatures = written(_prefix_signatures(ordered, percent))

    fits = 100 * F.least("n", "m") >= percent * F.greatest("n", "m")
    pivots = signatures.groupBy("sig").agg(F.min(F.struct("doc_id", "n")).alias("p"), F.count("*").alias("c")).where("c > 1").select("sig", F.col("p.doc_id").alias("a"), F.col("p.n").alias("m"))
    tried = written(signatures.join(pivots, "sig").where((F.col("doc_id") != F.col("a")) & fits).select("a", F.col("doc_id").alias("b")).distinct())
    links = written(_links(tried, sets, percent))
    labels = connected_components(links)

    # Buckets with several components: their sets are compared across components. Sets of n and
    # m tokens are similar only if they differ in (n + m)(100 - percent) / (100 + percent) or
    # fewer, which the parity maps rule out for nearly all others inside the join.
    placed = signatures.join(labels, F.col("doc_id") == F.col("id"), "left").select("sig", "doc_id", "n", F.coalesce("component", "doc_id").alias("component"))
    open_ = placed.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("low < high").select("sig", "blocks")
    maps = sets.select("doc_id", *[F.col("bits")[i].alias(f"x{i}") for i in range(WORDS)])
    left = written(placed.join(open_, "sig").join(maps, "doc_id").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")))
    # A large bucket is dealt by blocks of its sets: each block meets the whole bucket in a task of its own.
    other = left.select("sig", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("doc_id").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"), *[F.col(f"x{i}").alias(f"y{i}") for i in range(WORDS)])
    differ = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(1, WORDS)), F.bit_count(F.col("x0").bitwiseXOR(F.col("y0"))))
    close = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("m"))
    across = (F.col("a") < F.col("b")) & (F.col("component") != F.col("other"))
    more = left.withColumnRenamed("doc_id", "a").join(other, (left["sig"] == other["sig"]) & (left["block"] == other["block"]) & across & fits & close).select("a", "b").distinct()
    found = links.union(_links(more.join(tried, ["a", "b"], "left_anti"), sets, percent))
    discard(labels)
    found = written(found)
    labels = connected_components(found)

    members = join_by_class(every.select("doc_id", "digest"), classes, "digest", total).select("doc_id", "rep")
    members = written(members.join(labels, F.col("rep") == F.col("id"), "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("component")))
    discard(every, sets, signatures, classes, tried, links, left, found, labels)
    return sizes.join(members, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def every_document(docs: DataFrame, width: int = 5) -> DataFrame:
    """As ``jaccard_components``, and a row for each row with a null doc_id: its n_shingles and no component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(s) for s in shingles(batch.column(0), width)]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], ["doc_id", "n_shingles", "component_id"])

    nameless = docs.where(docs["doc_id"].isNull()).select(docs["text"]).mapInArrow(run, "doc_id long, n_shingles long, component_id long")
    return jaccard_components(docs, width).unionByName(nameless)
