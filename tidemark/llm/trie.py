"""The prefix trie of conversations, by truncation peeling.

A conversation is its path: 20 bytes a turn, 16 of a digest of role and text and 4 of the
text's length. Sorted by path, the conversations below a node lie side by side, so each
task peels its own stretch: from the greatest depth down, conversations that end there
join the nodes that survived from below, equal paths merge, and each node's last turn is
stripped, which makes it a survivor of the depth above. Nodes on the first or last path
of a stretch may go on in the neighbours; they stay open and, as partial sums, are
peeled again in a round of their own, until one stretch holds the few that are left.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, written

TURN, SHARED, HUNDRED = 20, 6, 100  # bytes of a turn in a path; opening turns taken are fewer than SHARED; conversations of a hundred share an opening
ROWS, BYTES = 5_000, 8 << 20  # of a stretch, and of the part of it that a task peels at once
OPEN_ROWS, PIECE = 100_000, 4096  # open nodes that one task closes; conversation ids in a piece
BROADCAST_ROWS, SALTS = 50_000, 16
PARTIAL = "path binary, smallest long, n long, children long, leaves long, saved long"
FOUND = "kind int, path binary, key binary, parent_key binary, conv_id long, depth int, parent_conv_id long, n long, children long, leaves long, saved long, ids string"
NODE, OPEN, IDS = 0, 1, 2
NOTHING = hashlib.sha256(b"").hexdigest()


def _key(path: bytes) -> bytes:
    return hashlib.blake2b(path, digest_size=16).digest()


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns as path bytes, under the conversation that lends its opening."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    code = F.concat(digest, F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))
    own = F.col("conv_id").cast("long")
    return conversations.where("conv_id IS NOT NULL").select((own - own % HUNDRED).alias("base"), own.alias("conv_id"), "turn", code.alias("code"))


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Paths from turns that come by base, the base's own first, then by conversation and turn."""
    base = now = None
    head, parts, kept = b"", [], 0

    def done() -> tuple[bytes, int]:
        codes = b"".join(parts)
        h = zlib.crc32(str(now).encode()) % SHARED
        return head[: TURN * h] + codes[TURN * h :], now

    for batch in batches:
        bases, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        codes = b"".join(batch.column(2).to_pylist())
        edges = np.flatnonzero(np.diff(ids)) + 1
        out: list[tuple[bytes, int]] = []
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(ids)] if len(ids) else []):
            if ids[a] != now:
                if now is not None:
                    out.append(done())
                if bases[a] != base:
                    base, head = bases[a], b""
                now, parts, kept = int(ids[a]), [], 0
            parts.append(codes[TURN * a : TURN * b])
            if now == base and kept < SHARED:
                head += parts[-1][: TURN * (SHARED - kept)]
                kept += b - a
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([c for _, c in out], pa.int64())], ["path", "smallest"])
    if now is not None:
        path, conv = done()
        yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([conv], pa.int64())], ["path", "smallest"])


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(path, smallest): every conversation's path, with the opening it takes from the first of its hundred."""
    turns = _turns(conversations).repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "code")
    return turns.select("base", "conv_id", "code").mapInArrow(_rebuild, "path binary, smallest long")


def _common(a: bytes, b: bytes) -> int:
    """Turns that two paths share from their start."""
    low, high = 0, min(len(a), len(b)) // TURN
    if a[: TURN * high] == b[: TURN * high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: TURN * mid] == b[: TURN * mid] else (low, mid)
    return low


class _Rows:
    """Sorted partial nodes: paths, five numbers each (smallest, n, children, leaves, saved), ids that end there, and whether a row was carried over."""

    def __init__(self) -> None:
        self.paths: list[bytes] = []
        self.numbers: list[np.ndarray] = []
        self.ids: list[bytes | None] = []
        self.carried = 0

    def add(self, paths: list[bytes], numbers: np.ndarray, ids: list[bytes | None]) -> None:
        self.paths += paths
        self.numbers.append(numbers)
        self.ids += ids


def _peel(rows: _Rows, first: bytes, ends: bool, final: bool, closing: bool) -> tuple[list[tuple], _Rows]:
    """Peel sorted rows; what is found, as rows of ``FOUND``, and the nodes carried to the next rows.

    ``ends``: nothing follows in this task. ``final``: no other task has rows. ``closing``:
    the rows are open nodes of an earlier round, whose ids are hashed elsewhere.
    """
    found: list[tuple] = []
    carry = _Rows()
    paths, stats = rows.paths, np.concatenate(rows.numbers)
    m = len(paths)
    depth = np.array([len(p) // TURN for p in paths])
    joint = np.array([*(_common(a, b) for a, b in zip(paths, paths[1:])), -1])
    with_first = np.minimum.accumulate([_common(first, paths[0]), *joint[:-1]])
    with_last = np.minimum.accumulate([depth[-1], *joint[:-1][::-1]])[::-1]
    order = np.argsort(depth, kind="stable")
    bounds = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    alive, sums = np.zeros(0, np.int64), np.zeros((0, 5), np.int64)
    waiting: list[tuple] = []  # nodes of the depth below whose parents are not known yet: row, then the row of FOUND
    for d in range(int(depth.max()), -1, -1):
        fresh = order[bounds[d] : bounds[d + 1]]
        if not len(fresh) and not len(alive):
            continue
        place = np.concatenate([alive, fresh])
        sums = np.concatenate([sums, stats[fresh]])
        by = np.argsort(place, kind="stable")
        place, sums = place[by], sums[by]
        gaps = np.minimum.reduceat(joint, place)[:-1]
        starts = np.concatenate([[0], np.flatnonzero(gaps < d) + 1])
        row = place[starts]
        merged = np.add.reduceat(sums, starts, axis=0)
        merged[:, 0] = np.minimum.reduceat(sums[:, 0], starts)
        on_first, on_last = with_first[row] >= d, with_last[row] >= d
        goes_on = on_last & (not ends)
        leaves_open = ~goes_on & (on_first | on_last) & (not final)
        closed = ~(goes_on | leaves_open)
        of_row = lambda r: np.searchsorted(row, r, "right") - 1
        ids: dict[int, list[bytes]] = {}
        carried = set()
        for r in fresh.tolist():
            if rows.ids[r] is not None:
                ids.setdefault(int(of_row(r)), []).append(rows.ids[r])
            if r < rows.carried or closing:
                carried.add(int(of_row(r)))
        for r, node in waiting:
            g = int(of_row(r))
            found.append((*node[:3], None, *node[4:6], int(merged[g, 0]), *node[7:]) if closed[g] else (*node[:3], _key(paths[r][: TURN * d]), *node[4:]))
        waiting = []
        merged[:, 3] = np.where(closed & (merged[:, 2] == 0), 1, merged[:, 3])
        for g, (r, (smallest, n, children, leaves, saved)) in enumerate(zip(row.tolist(), merged.tolist())):
            if closed[g]:
                if d:
                    saved += (n - 1) * int.from_bytes(paths[r][TURN * d - 4 : TURN * d], "big")
                    merged[g, 4] = saved
                ended = None if closing else hashlib.sha256(b",".join(ids[g])).hexdigest() if g in ids else NOTHING
                node = (NODE, None, _key(paths[r][: TURN * d]) if g in carried else None, None, smallest, d, None, n, children, leaves, saved, ended)
                waiting.append((r, node))
                continue
            path = paths[r][: TURN * d]
            if goes_on[g]:
                texts = ids.get(g, [])
                carry.add([path] * (1 + (len(texts) > 0)), np.array([[smallest, n, children, leaves, saved]] + [[smallest, 0, 0, 0, 0]] * (len(texts) > 0)), [None] + [b",".join(texts)] * (len(texts) > 0))
                continue
            found.append((OPEN, path, None, None, smallest, d, None, n, children, leaves, saved, None))
            listed = b",".join(ids.get(g, [])).split(b",") if g in ids else []
            for k in range(0, len(listed), PIECE):
                found.append((IDS, None, _key(path), None, int(listed[k]), d, None, 0, 0, 0, 0, b",".join(listed[k : k + PIECE]).decode()))
        alive = row[closed]
        sums = merged[closed]
        sums[:, 2] = 1
        if d == 0:
            found += [node for _, node in waiting]
    deep = sorted(range(len(carry.paths)), key=lambda k: len(carry.paths[k]))  # paths on one branch: by depth is sorted
    ordered = _Rows()
    if deep:
        ordered.add([carry.paths[k] for k in deep], np.concatenate(carry.numbers)[deep], [carry.ids[k] for k in deep])
    ordered.carried = len(deep)
    return found, ordered


def _stretch(batches: Iterator[pa.RecordBatch], final: bool, closing: bool, most: int) -> Iterator[pa.RecordBatch]:
    """Peel one task's sorted rows, ``most`` bytes of paths at a time."""

    def records(found: list[tuple]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string()]
        for k in range(0, len(found), 50_000):
            columns = zip(*found[k : k + 50_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in FOUND.split(", ")])

    first, rows, size = None, _Rows(), 0
    for batch in batches:
        paths, smallest = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        if not paths:
            continue
        first = paths[0] if first is None else first
        if closing:
            numbers = np.stack([batch.column(k).to_numpy() for k in range(1, 6)], 1)
        else:
            numbers = np.zeros((len(paths), 5), np.int64)
            numbers[:, 0], numbers[:, 1] = smallest, 1
        a = 0
        for b in range(1, len(paths) + 1):
            size += len(paths[b - 1]) + 64
            if b == len(paths) or size > most:
                rows.add(paths[a:b], numbers[a:b], [None] * (b - a) if closing else [b"%d" % c for c in smallest[a:b].tolist()])
                a = b
            if size > most:
                found, rows = _peel(rows, first, False, final, closing)
                yield from records(found)
                size = sum(map(len, rows.paths)) // 2
    if rows.paths:
        found, _ = _peel(rows, first, True, final, closing)
        yield from records(found)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each node's ids, from their pieces in order, one piece held at a time."""
    key, state = None, None
    for batch in batches:
        out = []
        for k, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if k == key:
                state.update(b",")
            else:
                if key is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([h for _, h in out], pa.string())], ["key", "ids"])
    if key is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()], pa.string())], ["key", "ids"])


def prefix_trie(conversations: DataFrame, rows_a_stretch: int = ROWS, open_rows: int = OPEN_ROWS, most: int = BYTES) -> DataFrame:
    """The trie's nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``conversations`` has conv_id, turn, role and text. Turns come in order of ``turn``,
    null first, equal ones by a digest of role and text; a repeated row is a turn of its
    own. A null role or text is empty. Rows without a conv_id belong to no conversation
    and are left out; an empty table has no node, not even the root. Other columns are not read.
    Turns are told apart by 128 bits of SHA-256 and the text's length.

    One shuffle brings turns together by the conversation that lends their opening (20
    bytes a turn, whatever its text), a second one, by ranges of (path, conv_id), deals
    conversations evenly however many share a turn or are copies. A task holds some
    megabytes of paths, and one whole path: 20 bytes a turn. The ids that end at an open
    node travel as pieces and are hashed in order without being gathered.
    """
    convs = written(rebuilt(conversations))
    sized = convs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("path")), F.lit(0)).alias("bytes")).first()
    parts = max(-(-sized["n"] // rows_a_stretch), -(-sized["bytes"] // (4 * most)))
    dealt = convs.repartitionByRange(parts, "path", "smallest") if parts > 1 else convs.coalesce(1)
    rounds = [written(dealt.sortWithinPartitions("path", "smallest").mapInArrow(partial(_stretch, final=parts <= 1, closing=False, most=most), FOUND))]
    discard(convs)
    pieces = rounds[0].where(F.col("kind") == IDS).select("key", "conv_id", "ids")
    while parts > 1:
        left = rounds[-1].where(F.col("kind") == OPEN).selectExpr("path", "conv_id AS smallest", "n", "children", "leaves", "saved")
        parts = min(-(-left.count() // open_rows), parts // 2)
        dealt = left.repartitionByRange(parts, "path", "smallest") if parts > 1 else left.coalesce(1)
        rounds.append(written(dealt.sortWithinPartitions("path", "smallest").mapInArrow(partial(_stretch, final=parts <= 1, closing=True, most=most), FOUND)))
    nodes = rounds[0].where(F.col("kind") == NODE)
    if len(rounds) > 1:
        hashed = pieces.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ids").mapInArrow(_hashes, "key binary, ids string")
        closed = rounds[1]
        for one in rounds[2:]:
            closed = closed.union(one)
        closed = closed.where(F.col("kind") == NODE).drop("ids").join(hashed, "key", "left").withColumn("ids", F.coalesce("ids", F.lit(NOTHING)))
        nodes = nodes.unionByName(closed)
    known = written(nodes.select("key", "parent_key", "conv_id", "depth", "parent_conv_id", "n", "children", "leaves", "saved", "ids"))
    discard(*rounds)
    parents = known.where("key IS NOT NULL").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent"))
    orphans = known.where("parent_key IS NOT NULL")
    if parents.count() <= BROADCAST_ROWS:
        adopted = orphans.join(F.broadcast(parents), "parent_key")
    else:  # a parent may have most nodes as its children
        parents = parents.withColumn("salt", F.explode(F.array(*map(F.lit, range(SALTS)))))
        adopted = orphans.withColumn("salt", (F.hash("conv_id") & (SALTS - 1))).join(parents, ["parent_key", "salt"])
    result = known.where("parent_key IS NULL").withColumn("parent", F.col("parent_conv_id")).unionByName(adopted.drop("salt"))
    return result.select("conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.col("ids").alias("ends_sha256"))


_CRC = "list_reduce(list_concat([4294967295], range(8 * len(b))), lambda a, j: CASE WHEN {x} % 2 = 1 THEN xor({x} // 2, 3988292384) ELSE {x} // 2 END)".replace("{x}", "(CASE WHEN j % 8 = 0 THEN xor(a, b[j // 8 + 1]) ELSE a END)")
#: The trie over again, node by node, with every prefix as a list of turns; the checksum bit by bit.
SQL = f"""
WITH t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32)) AS i, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % {HUNDRED} AS base, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS b FROM t GROUP BY conv_id),
h AS (SELECT s.conv_id, s.base, xor({_CRC}, 4294967295) % {SHARED} AS h FROM s),
g AS (SELECT h.conv_id, base, h, least(h, coalesce(n, 0)) AS taken FROM h LEFT JOIN (SELECT conv_id AS of_base, n FROM s) o ON o.of_base = base),
u AS (SELECT g.conv_id, i AS place, r, x FROM g JOIN t ON t.conv_id = base AND i <= h UNION ALL SELECT g.conv_id, taken + i - h, r, x FROM g JOIN t ON t.conv_id = g.conv_id AND i > h),
w AS (SELECT g.conv_id, list({{'r': r, 'x': x}} ORDER BY place) FILTER (WHERE place IS NOT NULL) AS path FROM g LEFT JOIN u ON u.conv_id = g.conv_id GROUP BY g.conv_id),
p AS (SELECT conv_id, d, coalesce(len(path), 0) AS n, coalesce(path, [])[1:d] AS pre FROM w, unnest(range(0, coalesce(len(path), 0) + 1)) AS v(d)),
m AS (SELECT d, pre, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CASE WHEN d = n THEN conv_id END, ',' ORDER BY conv_id) AS ends FROM p GROUP BY d, pre),
k AS (SELECT a.d AS d, a.pre AS pre, count(b.d) AS n_children FROM m a LEFT JOIN m b ON b.d = a.d + 1 AND b.pre[1:a.d] = a.pre GROUP BY a.d, a.pre),
f AS (SELECT m.*, n_children FROM m JOIN k USING (d, pre)),
z AS (SELECT a.d AS d, a.pre AS pre, sum(CASE WHEN b.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(CASE WHEN b.d = 0 THEN 0 ELSE (b.n_convs - 1) * length(b.pre[b.d].x) END) AS saved_tokens FROM f a JOIN f b ON b.d >= a.d AND b.pre[1:a.d] = a.pre GROUP BY a.d, a.pre)
SELECT f.conv_id AS conv_id, CAST(f.d AS BIGINT) AS depth, q.conv_id AS parent_conv_id, f.n_convs AS n_convs, f.n_children AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(f.ends, '')) AS ends_sha256
FROM f JOIN z ON z.d = f.d AND z.pre = f.pre LEFT JOIN f q ON q.d = f.d - 1 AND f.d > 0 AND f.pre[1:q.d] = q.pre"""
