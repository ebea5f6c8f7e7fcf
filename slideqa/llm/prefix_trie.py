"""The trie of conversation prefixes: who shares which opening turns, and what storing each shared turn once saves.

A conversation is a sequence of turn digests (128 bits of SHA-256 over role and text). Sequences are sorted by range
partitioning, so the members of any prefix stand in one interval of the order. LCP[i] is the number of turns that
row i shares with the row before it; the members of the first d turns of row i reach as far as LCP stays at d or more.

- A partition is one block. It gets the last row of the block before and the first row of the block after, so every
  LCP is known. A sparse table of the LCPs' minima answers range minima; each candidate prefix (i, d) binary-searches
  its right extent in it, and its parent (i, d - 1) the left and right one, all apart from each other and at once for
  the block, without a stack. Row i heads the prefixes of depth LCP[i] < d <= length, so each prefix of a block is met
  once.
- Members, leaves and saved tokens are differences of prefix sums over the interval; the smallest member is a range
  minimum, too.
- A prefix that goes on in a neighbouring block gives a fragment a block. Fragments, at most two per block and turn of
  the rows at its ends, are summed by the SHA-256 of the prefix. So a prefix that a third of all conversations share
  is a row a block, and nothing meets in one task but these.
- The ids of equal conversations are hashed where they stand; a run over several blocks sends one string a block,
  which one task feeds to the hash in their order, one at a time.

A conversation's turns must fit a row: 24 bytes a turn, not the texts. A block has about ``BLOCK`` conversations,
or fewer if there are more shuffle partitions.

Defined results: null roles and texts are empty ones; rows without conv_id are of no conversation. Turns of one
conversation with the same number stand by their digests; repeated rows are turns, too. An empty table has no nodes,
not even a root. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slideqa.llm.tables import Saved, table

#: Conversations of a block.
BLOCK = 100_000
#: Rows of open prefixes up to which they are sent to all tasks: 40 bytes each.
BROADCAST = 200_000
#: Conversations that share a stem, and the most turns that a rebuilt one takes over from its stem.
FAMILY, STEM = 100, 6
WIDTH = 16
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_PIECE = f"kind int, part long, node binary, parent binary, {NODE}, ids binary"
_EMPTY = hashlib.sha256(b"").hexdigest()
_DONE, _ORPHAN, _OPEN, _IDS = range(4)


def sequences(turns: DataFrame) -> DataFrame:
    """conv_id, t (array of d, the turn's digest in hex, and n, the code points of its text): a row a conversation, in
    turn order, null first."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("d"), F.length(text).cast("long").alias("n")).alias("t"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", F.transform("t", lambda x: F.struct(x["d"].alias("d"), x["n"].alias("n"))).alias("t"))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Conversations whose first h turns are those of the first one of their family (conv_id - conv_id % 100),
    h = crc32(conv_id) % 6; then their own turns after h. As (conv_id, t), from ``sequences``."""
    own, none = sequences(turns), F.array().cast("array<struct<d: string, n: bigint>>")
    stems = sequences(turns.where(F.col("conv_id") % FAMILY == 0)).select(F.col("conv_id").alias("stem"), F.slice("t", 1, STEM).alias("s"))
    h = (F.crc32(F.col("conv_id").cast("string")) % STEM).cast("int")
    rows = own.withColumns({"stem": F.col("conv_id") - F.col("conv_id") % FAMILY, "h": h}).join(stems, "stem", "left")
    rest = F.slice("t", F.col("h") + 1, F.greatest(F.size("t") - F.col("h"), F.lit(0)))
    return rows.select("conv_id", F.concat(F.slice(F.coalesce("s", none), F.lit(1), F.col("h")), rest).alias("t"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", F.unhex(F.array_join(F.transform("t", lambda x: x["d"]), "")).alias("key"), F.transform("t", lambda x: x["n"]).alias("sizes"))


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k holds the minimum of 2**k values from each place on."""
    levels = [values]
    while 2 << (len(levels) - 1) <= len(values):
        last, half = levels[-1], 1 << (len(levels) - 1)
        levels.append(np.minimum(last[:-half], last[half:]))
    return levels


def range_minimum(levels: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The minimum of values[low:high], for arrays of non-empty ranges."""
    out, level = np.empty(len(low), levels[0].dtype), np.frexp(high - low)[1] - 1
    for k in np.unique(level):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(levels[k][low[at]], levels[k][high[at] - (1 << k)])
    return out


def right_end(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The first place after ``row`` whose value is below ``depth``; the number of values if there is none."""
    at, n = row + 1, len(levels[0])
    for k in range(len(levels) - 1, -1, -1):
        inside = at + (1 << k) <= n
        deep = levels[k][np.where(inside, at, 0)] >= depth
        at = np.where(inside & deep, at + (1 << k), at)
    return at


def left_end(levels: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The smallest place from which all values up to ``row`` are ``depth`` or more, its own left out."""
    at = row.copy()
    for k in range(len(levels) - 1, -1, -1):
        inside = at >= 1 << k
        deep = levels[k][np.where(inside, at - (1 << k) + 1, 0)] >= depth
        at = np.where(inside & deep, at - (1 << k), at)
    return at


def common_turns(keys: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row after the first: how many turns it begins with that the row before it begins with, too. keys: two
    numbers a turn."""
    both = np.minimum(sizes[:-1], sizes[1:])
    before = np.cumsum(both) - both
    turn = np.arange(both.sum()) - np.repeat(before, both)
    a, b = np.repeat(starts[:-1], both) + turn, np.repeat(starts[1:], both) + turn
    same = (keys[a] == keys[b]).all(axis=1)
    out, some = both.copy(), np.flatnonzero(both)
    if len(some):
        out[some] = np.minimum.reduceat(np.where(same, np.repeat(both, both), turn), before[some])
    return out


def _block(rows: pa.Table) -> pa.Table:
    rows = rows.combine_chunks().sort_by([("side", "ascending"), ("at", "ascending")])
    side = rows["side"].to_numpy()
    keys, lists = rows["key"].combine_chunks(), rows["sizes"].combine_chunks()
    raw = keys.buffers()[2]
    first = int(np.frombuffer(keys.buffers()[1], np.int32 if keys.type == pa.binary() else np.int64)[keys.offset])
    turns = pc.binary_length(keys).to_numpy(zero_copy_only=False).astype(np.int64) // WIDTH
    starts = np.cumsum(turns) - turns
    data = (np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8))[first : first + int(turns.sum()) * WIDTH]
    shared = common_turns(data.view(np.uint64).reshape(-1, 2), starts, turns)
    lower, n = int((side < 0).sum()), int((side == 0).sum())
    before, after = lower == 1, lower + n < len(side)
    own = slice(lower, lower + n)
    lcp = np.full(n + 1, -1, np.int64)
    lcp[1:n] = shared[lower : lower + n - 1]
    if before:
        lcp[0] = shared[0]
    if after:
        lcp[n] = shared[-1]
    length, starts, conv = turns[own], starts[own], rows["conv_id"].to_numpy()[own]
    sums = np.zeros(int(turns.sum()) + 1, np.int64)
    np.cumsum(lists.flatten().to_numpy(), out=sums[1:])
    text_before = lambda row, turn: sums[starts[row] + turn] - sums[starts[row]]  # noqa: E731  code points of a row's first turns

    # candidates: row 0 with every depth, other rows with those they head
    least = lcp[:n] + 1
    least[0] = 0
    counts = length - least + 1
    offset = np.cumsum(counts) - counts
    row = np.repeat(np.arange(n), counts)
    depth = np.arange(len(row)) - np.repeat(offset, counts) + np.repeat(least, counts)
    head = (row > 0) | (depth > lcp[0])
    levels, smallest = sparse_table(lcp[:n]), sparse_table(conv)
    end = right_end(levels, row, depth)
    done = head & ~((end == n) & (depth <= lcp[n]))

    every = np.arange(n)
    total = text_before(every, length)
    new = total - text_before(every, np.maximum(lcp[:n], 0))
    leaf = lcp[1:] < length
    of = lambda x: np.concatenate([[0], np.cumsum(x)])
    totals, news, leaves = of(total), of(new), of(leaf)
    members, above = end - row, text_before(row, np.maximum(depth - 1, 0))
    alone = np.where(head, total[row] - above, new[row]) + news[end] - news[row + 1]
    saved = totals[end] - totals[row] - members * above - alone

    up = np.maximum(depth - 1, 0)
    left, right = left_end(levels, row, up), right_end(levels, row, up)
    left = np.where(up > lcp[row], row, left)
    parent = offset[left] + up - least[left]
    child = head & (depth > 0)
    children = np.bincount(parent[child], minlength=len(row))
    known = child & done[parent]
    parent_conv = np.zeros(len(row), np.int64)
    parent_conv[known] = range_minimum(smallest, left[known], right[known])

    # runs of equal conversations: the members that end at a node
    ends: list[str | None] = [None] * len(row)
    fresh = np.ones(n, bool)
    fresh[1:] = (lcp[1:n] < length[1:]) | (length[1:] != length[:-1])
    runs = np.append(np.flatnonzero(fresh), n)
    goes_on = after and lcp[n] == length[-1] == turns[lower + n]
    came_in = before and lcp[0] == length[0] == turns[0]
    pieces = []
    for a, b in zip(runs[:-1].tolist(), runs[1:].tolist(), strict=True):
        at, ids = int(offset[a] + length[a] - least[a]), ",".join(map(str, conv[a:b].tolist())).encode()
        if (a == 0 and came_in) or (b == n and goes_on):
            pieces.append((at, ids))
        else:
            ends[at] = hashlib.sha256(ids).hexdigest()

    names: dict[int, bytes] = {}

    def name(at: int) -> bytes:
        if at not in names:
            begin = int(starts[row[at]]) * WIDTH
            names[at] = hashlib.sha256(data[begin : begin + int(depth[at]) * WIDTH]).digest()
        return names[at]

    kind = np.where(done, np.where(known | (depth == 0), _DONE, _ORPHAN), _OPEN)
    part = rows["part"][0].as_py()
    nameless = (kind == _DONE) | (depth == 0)
    up_names = [None if x else name(p) for x, p in zip(nameless.tolist(), parent.tolist(), strict=True)]
    columns = {
        "kind": pa.array(kind.astype(np.int32)), "part": pa.array(np.full(len(row), part)), "node": pa.array([name(i) if k == _OPEN else None for i, k in enumerate(kind.tolist())], pa.binary()), "parent": pa.array(up_names, pa.binary()),
        "conv_id": pa.array(range_minimum(smallest, row, end)), "depth": pa.array(depth), "parent_conv_id": pa.array(parent_conv, mask=~known), "n_convs": pa.array(members), "n_children": pa.array(children),
        "n_leaves": pa.array(leaves[end] - leaves[row]), "saved_tokens": pa.array(saved), "ends_sha256": pa.array([_EMPTY if e is None and k != _OPEN else e for e, k in zip(ends, kind.tolist(), strict=True)], pa.string()), "ids": pa.nulls(len(row), pa.binary()),
    }
    out = pa.table(columns)
    if pieces:
        more = {f.name: pa.nulls(len(pieces), f.type) for f in out.schema} | {"kind": pa.array([_IDS] * len(pieces), pa.int32()), "part": pa.array([part] * len(pieces), pa.int64()), "node": pa.array([name(at) for at, _ in pieces], pa.binary()), "ids": pa.array([ids for _, ids in pieces], pa.binary())}
        out = pa.concat_tables([out, pa.table(more)])
    return out


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, ids by node and part -> node, SHA-256 of the comma-joined ids; one piece is held at a time."""
    node, state, out = None, hashlib.sha256(), []
    for batch in batches:
        for key, ids in zip(batch.column("node"), batch.column("ids"), strict=True):
            if node != key.as_py():
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = key.as_py(), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_buffer())
    if node is not None:
        out.append((node, state.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.binary()), pa.array([b for _, b in out], pa.string())], ["node", "hash"])


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes over conversations given as (conv_id, t: array of (d, n)), from ``sequences`` or ``rebuilt``."""
    spark, names = conversations.sparkSession, [x.split()[0] for x in NODE.split(", ")]
    rows = Saved(_keyed(conversations), "conversations")
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.df.count() // block))
    ordered = rows.df.repartitionByRange(blocks, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("at", F.monotonically_increasing_id())
    ordered = Saved(ordered.withColumn("part", F.shiftright("at", 33)), "ordered")
    rows.drop()
    # a row a block: where it begins and ends
    edges = sorted(map(tuple, ordered.df.groupBy("part").agg(F.min("at"), F.max("at")).collect()))
    sent = [(p[2], q[0], -1) for p, q in zip(edges, edges[1:], strict=False)] + [(q[1], p[0], 1) for p, q in zip(edges, edges[1:], strict=False)]
    guests = ordered.df.drop("part").join(F.broadcast(spark.createDataFrame(sent, "at long, part long, side int")), "at")
    both = ordered.df.withColumn("side", F.lit(0)).unionByName(guests)
    pieces = Saved(both.groupBy("part").applyInArrow(_block, _PIECE), "pieces").df
    ordered.drop()

    strings = pieces.where(F.col("kind") == _IDS).select("node", "part", "ids")
    hashes = strings.repartition(blocks, "node").sortWithinPartitions("node", "part").drop("part").mapInArrow(_hashed, "node binary, hash string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    open_ = pieces.where(F.col("kind") == _OPEN).groupBy("node").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    open_ = Saved(open_.join(hashes, "node", "left").withColumn("ends_sha256", F.coalesce("hash", "ends_sha256", F.lit(_EMPTY))).drop("hash"), "open").df
    parents = open_.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    parents = F.broadcast(parents) if parents.count() <= BROADCAST else parents
    orphans = pieces.where(F.col("kind") == _ORPHAN).drop("parent_conv_id").join(parents, "parent")
    met = open_.join(parents, "parent", "left")
    return pieces.where(F.col("kind") == _DONE).select(*names).unionByName(orphans.select(*names)).unionByName(met.select(*names))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(table(spark, sf_dir, "conversations")))


OP13_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, left(sha256(strlen(role)::VARCHAR || ':' || role || text), 32)) AS turns FROM t GROUP BY conv_id),
crc AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
        lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda b, k: xor(b >> 1, (b & 1) * 3988292384))), 4294967295::BIGINT) % 6 AS h FROM own),
r AS (SELECT a.conv_id AS c, list_concat(coalesce(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM crc a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100),
p AS (SELECT c, d, turns[1:d] AS prefix, len(turns) = d AS ends FROM (SELECT c, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
g AS (SELECT d, prefix, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY d, prefix),
k AS (SELECT d - 1 AS d, prefix[1:d - 1] AS prefix, count(*) AS n FROM g WHERE d > 0 GROUP BY ALL),
n AS (SELECT g.*, coalesce(k.n, 0) AS n_children, CASE WHEN g.d > 0 THEN (n_convs - 1) * length(g.prefix[g.d].text) ELSE 0 END AS saved FROM g LEFT JOIN k ON k.d = g.d AND k.prefix = g.prefix),
s AS (SELECT a AS d, prefix[1:a] AS prefix, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM n) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s ON s.d = n.d AND s.prefix = n.prefix LEFT JOIN g u ON u.d = n.d - 1 AND u.prefix = n.prefix[1:n.d - 1]
"""
