"""Prefix trie of conversations: what a cache of shared prefixes would save.

A conversation is a sequence of turns, and a node of the trie is a sequence that conversations start
with.  Turns become digests where they are read; texts are never shuffled.  Each conversation then
gets its path, a key of 16 bytes for each of its prefixes, and equal conversations become one
sequence with their number and the digest of their ids, whose runs are cut by ranges of ids, so that no group of
equal conversations meets in one task.

Sequences are hash-partitioned by their first turn.  A bucket's tries are built as pointer
dictionaries inside `applyInPandas` and summed up by an iterative postorder.  A first turn with
over `most` turns below it is dealt again by its next turn, then by the next two, four, and so on,
until every part fits; the nodes above the parts, its crown, are summed by key across
tasks from what the parts and the crown's own nodes give to their ancestors.

Turns are ordered by number, null first; turns of one number by role and digest.  A null role or
text counts as empty.  Rows without a conv_id take no part.  A repeated row is a turn of its own.  An
empty table has no nodes, not even a root.  One conversation's turns travel as one row of about 40 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.llm.common import batches, read_table, stored

KEY = 16
#: Turns of different sequences that a trie built by one call may hold, on average and, where a turn can split them, at most.
MOST_TURNS = 2048
#: Ids of equal conversations that one row holds.
RUN_IDS = 1 << 14
#: Tables of at most so many keys are broadcast; larger ones are joined by key.
BROADCAST_KEYS = 1 << 16
EVERY, HEAD = 20, 4
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NONE = hashlib.sha256(b"").hexdigest()


def ordered(conversations: DataFrame, *keys: str) -> DataFrame:
    """(keys, conv_id, turns) with a conversation's turns, (turn, role, digest, words), in order; dealt by the first of `keys`, expressions on conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, KEY)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = (
        conversations.where("conv_id is not null")
        .select("conv_id", F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), words.alias("words")).alias("t"))
        .withColumns({f"key{i}": F.expr(k) for i, k in enumerate(keys)})
    )
    names = [f"key{i}" for i in range(len(keys))]
    return turns.repartition(*names[:1] or ["conv_id"]).groupBy(*names, "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = EVERY, head: int = HEAD) -> DataFrame:
    """(conv_id, turns): the first h turns of conversation c - c % every, then c's own after its first h; h is crc32(c) % head.

    As in SQL, the remainder of a negative number is negative or zero.
    """
    own = ordered(conversations, f"conv_id - conv_id % {every}")
    first = F.first(F.when(F.col("conv_id") == F.col("key0"), F.slice("turns", 1, head - 1)), ignorenulls=True).over(Window.partitionBy("key0"))
    h = (F.crc32(F.col("conv_id").cast("string")) % head).cast("int")
    after = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    return own.withColumn("first", first).select("conv_id", F.concat(F.coalesce(F.slice("first", F.lit(1), h), F.slice("turns", 1, 0)), after).alias("turns"))


def _keyed(turns: DataFrame) -> DataFrame:
    """(tail, conv_id, path, words): path has a key for each prefix, tail is the last of them."""

    def keyed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            tails, paths = [], []
            for digests in part.column("digests").to_pylist():
                key, path = b"", []
                for digest in digests:
                    key = hashlib.sha256(key + digest).digest()[:KEY]
                    path.append(key)
                tails.append(key)
                paths.append(b"".join(path))
            yield pa.RecordBatch.from_arrays(
                [pa.array(tails, pa.binary()), part.column("conv_id"), pa.array(paths, pa.binary()), part.column("words")], names=["tail", "conv_id", "path", "words"]
            )

    return turns.select("conv_id", F.col("turns.digest").alias("digests"), F.col("turns.words").alias("words")).mapInArrow(
        keyed, "tail binary, conv_id long, path binary, words array<long>"
    )


def _runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (tail, conv_id) to rows of at most RUN_IDS ids of one tail."""
    out: list[tuple] = []
    held: list[int] = []
    last: tuple | None = None

    def close() -> None:
        if held:
            out.append((last[0], held[0], len(held), ",".join(map(str, held)), last[1], last[2]))
            held.clear()

    def given() -> Iterator[pa.RecordBatch]:
        columns = list(zip(*out)) or [()] * 6
        kinds = (pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()))
        yield from batches({n: (list(c), k) for n, c, k in zip(("tail", "first", "n", "ids", "path", "words"), columns, kinds)})
        out.clear()

    for part in parts:
        for tail, conv, path, words in zip(*(part.column(c).to_pylist() for c in ("tail", "conv_id", "path", "words"))):
            if last is None or tail != last[0] or len(held) >= RUN_IDS:
                close()
                last = (tail, path, words)
            held.append(conv)
        yield from given()
    close()
    yield from given()


def _ended(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by (tail, first) to one row a tail: its ids' digest is taken run by run."""
    out: list[tuple] = []
    now: list | None = None

    def given() -> Iterator[pa.RecordBatch]:
        columns = list(zip(*out)) or [()] * 5
        kinds = (pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string())
        yield from batches({n: (list(c), k) for n, c, k in zip(("path", "words", "n", "first", "ends"), columns, kinds)})
        out.clear()

    def close() -> None:
        if now is not None:
            out.append((now[1], now[2], now[3], now[4], now[5].hexdigest()))

    for part in parts:
        for tail, first, n, ids, path, words in zip(*(part.column(c).to_pylist() for c in ("tail", "first", "n", "ids", "path", "words"))):
            if now is None or tail != now[0]:
                close()
                now = [tail, path, words, n, first, hashlib.sha256(ids.encode())]
            else:
                now[3] += n
                now[5].update(("," + ids).encode())
        yield from given()
    close()
    yield from given()


def sequences(turns: DataFrame) -> DataFrame:
    """(path, words, n, first, ends): the different sequences of (conv_id, turns), stored."""
    keyed = stored(_keyed(turns), "trie-paths")
    runs = keyed.repartitionByRange("tail", "conv_id").sortWithinPartitions("tail", "conv_id").mapInArrow(_runs, "tail binary, first long, n long, ids string, path binary, words array<long>")
    ended = runs.repartition("tail").sortWithinPartitions("tail", "first").mapInArrow(_ended, "path binary, words array<long>, n long, first long, ends string")
    return stored(ended, "trie-sequences")


class Trie:
    """Pointer dictionaries over the keys of paths, from depth `top` down."""

    def __init__(self, top: int):
        self.top, self.tops = top, {}
        self.children: list[dict[bytes, int]] = []
        self.depth, self.n, self.first, self.words, self.ends, self.path = [], [], [], [], [], []

    def _node(self, at: dict[bytes, int], key: bytes, depth: int, words: int) -> int:
        found = at.get(key)
        if found is None:
            found = at[key] = len(self.depth)
            self.children.append({})
            self.depth.append(depth)
            self.n.append(0)
            self.first.append(None)
            self.words.append(words)
            self.ends.append(NONE)
            self.path.append(None)
        return found

    def add(self, path: bytes, words, n: int, first: int, ends: str) -> None:
        at, node = self.tops, -1
        for depth in range(self.top, len(path) // KEY + 1):
            node = self._node(at, path[KEY * (depth - 1) : KEY * depth], depth, int(words[depth - 1]))
            self.n[node] += n
            self.first[node] = first if self.first[node] is None else min(first, self.first[node])
            if depth == self.top and self.path[node] is None:
                self.path[node] = path[: KEY * (depth - 1)]
            at = self.children[node]
        self.ends[node] = ends

    def summed(self) -> tuple[list[int], list[int], list[int | None]]:
        """Leaves and saved tokens below each node, itself included, and its parent: an iterative postorder."""
        size = len(self.depth)
        leaves, saved, parent = [0] * size, [0] * size, [None] * size
        stack = [(node, False) for node in self.tops.values()]
        while stack:
            node, left = stack.pop()
            if not left:
                stack.append((node, True))
                for child in self.children[node].values():
                    parent[child] = node
                    stack.append((child, False))
                continue
            leaves[node] += not self.children[node]
            saved[node] += (self.n[node] - 1) * self.words[node]
            if parent[node] is not None:
                leaves[parent[node]] += leaves[node]
                saved[parent[node]] += saved[node]
        return leaves, saved, parent


_TRIE = f"{NODE}, kind int, key binary"
#: Kinds of rows that a trie gives: a node, a top whose parent is in the crown, sums for a node of the crown.
WHOLE, TOP, SUMS = 0, 1, 2


def _tries(rows: DataFrame, top: int, buckets: int, root: int) -> DataFrame:
    """Nodes of the sequences' tries from depth `top` down, and sums for their ancestors."""

    def built(part: pd.DataFrame) -> pd.DataFrame:
        trie = Trie(top)
        for row in zip(part["path"], part["words"], part["n"], part["first"], part["ends"]):
            trie.add(*row)
        leaves, saved, parent = trie.summed()
        given: dict[bytes, list[int]] = {}
        out = []
        for node, depth in enumerate(trie.depth):
            above, kind, key = parent[node], WHOLE, None
            conv = root if depth == 1 else None
            if above is not None:
                conv = trie.first[above]
            else:
                path = trie.path[node]
                for j in range(top):
                    sums = given.setdefault(path[KEY * (j - 1) : KEY * j] if j else b"", [0, 0, 0])
                    sums[0] += leaves[node]
                    sums[1] += saved[node]
                    sums[2] += j == top - 1
                if depth > 1:
                    kind, key = TOP, path[-KEY:]
            out.append((trie.first[node], depth, conv, trie.n[node], len(trie.children[node]), leaves[node], saved[node], trie.ends[node], kind, key))
        out += [(None, None, None, None, c, l, s, None, SUMS, k) for k, (l, s, c) in given.items()]
        names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "kind", "key"]
        frame = pd.DataFrame(out, columns=names)
        return frame.astype({c: "Int64" for c in names[:7]} | {"kind": "int32"})

    bucket = F.pmod(F.xxhash64("part"), F.lit(buckets)).alias("bucket")
    return rows.groupBy(bucket).applyInPandas(built, _TRIE)


def _depth() -> Column:
    return F.expr(f"octet_length(path) div {KEY}")


def _prefix(length: Column) -> Column:
    """The key of the prefix of so many turns; the root's is empty."""
    return F.when(length == 0, F.lit(b"")).otherwise(F.col("path").substr(length * KEY - KEY + 1, F.lit(KEY)))


def _crown(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Nodes of depth low to high - 1: key, path, depth, n_convs, conv_id, deepest, words, ends_sha256."""
    at = F.explode(F.sequence(F.lit(low), F.least(F.lit(high - 1), _depth().cast("int"))))
    each = rows.withColumn("d", at)
    return each.groupBy(_prefix(F.col("d")).alias("key"), F.col("d").cast("long").alias("depth")).agg(
        F.min(F.when(F.col("d") == 0, F.lit(b"")).otherwise(F.col("path").substr(F.lit(1), F.col("d") * KEY))).alias("path"),
        F.sum("n").alias("n_convs"),
        F.min("first").alias("conv_id"),
        F.max(_depth()).alias("deepest"),
        F.max(F.when(F.col("d") == 0, 0).otherwise(F.get("words", F.col("d") - 1))).alias("words"),
        F.coalesce(F.max(F.when(_depth() == F.col("d"), F.col("ends"))), F.lit(NONE)).alias("ends_sha256"),
    )


def _given(crown: DataFrame) -> DataFrame:
    """What the crown's nodes give to themselves and their ancestors: key, n_leaves, saved_tokens, n_children."""
    each = crown.withColumn("d", F.explode(F.sequence(F.lit(0), F.col("depth").cast("int"))))
    return each.select(
        _prefix(F.col("d")).alias("key"),
        (F.col("deepest") == F.col("depth")).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
        (F.col("d") == F.col("depth") - 1).cast("long").alias("n_children"),
    )


def _small(table: DataFrame, rows: int) -> DataFrame:
    """For a join: broadcast if its counted rows are few, else left to meet by key, where hot partitions can be split."""
    return F.broadcast(table) if rows <= BROADCAST_KEYS else table


def trie(turns: DataFrame, most: int = MOST_TURNS) -> DataFrame:
    """The nodes of the trie of (conv_id, turns)."""
    spark = turns.sparkSession
    rows = sequences(turns)
    of_all = rows.agg(F.sum(_depth()).alias("turns"), F.min("first").alias("first")).first()
    if of_all["first"] is None:
        return spark.createDataFrame([], NODE)
    buckets, root = max(1, -(-of_all["turns"] // most)), of_all["first"]
    crowns, built, low = [_crown(rows, 0, 1)], [], 1
    while True:
        rows = rows.where(_depth() >= low).withColumn("part", _prefix(F.lit(low)))
        sizes = rows.groupBy("part").agg(F.sum(_depth() - (low - 1)).alias("turns"), F.count("*").alias("rows"))
        big = stored(sizes.where((F.col("turns") > most) & (F.col("rows") > 1)).select("part"), "trie-big")
        n = big.count()
        fits = rows.join(_small(big, n), "part", "left_anti") if n else rows
        built.append(stored(_tries(fits, low, buckets, root), "trie-nodes"))
        if not n:
            break
        rows = stored(rows.join(_small(big, n), "part", "left_semi").drop("part"), "trie-open")
        crowns.append(_crown(rows, low, 2 * low))
        low *= 2
    crown = crowns[0]
    for more in crowns[1:]:
        crown = crown.unionByName(more)
    crown = stored(crown, "trie-crown")
    below = built[0]
    for more in built[1:]:
        below = below.unionByName(more)
    sums = (
        below.where(F.col("kind") == SUMS)
        .select("key", "n_leaves", "saved_tokens", "n_children")
        .unionByName(_given(crown))
        .groupBy("key")
        .agg(*(F.sum(c).alias(c) for c in ("n_leaves", "saved_tokens", "n_children")))
    )
    names = [c.split()[0] for c in NODE.split(", ")]
    above = _small(crown.select(F.col("key").alias("above"), F.col("conv_id").alias("above_conv")), crown.count())
    parent = F.when(F.col("depth") > 0, _prefix(F.col("depth") - 1))
    upper = crown.join(sums, "key").withColumn("above", parent).join(above, "above", "left").withColumn("parent_conv_id", F.col("above_conv")).select(names)
    tops = below.where(F.col("kind") == TOP).withColumn("above", F.col("key")).join(above, "above", "left").withColumn("parent_conv_id", F.col("above_conv")).select(names)
    return upper.unionByName(below.where(F.col("kind") == WHOLE).select(names)).unionByName(tops)


def query(spark, sf_dir: str) -> DataFrame:
    """op11: the trie of the rebuilt `conversations`."""
    return trie(rebuilt(read_table(spark, sf_dir, "conversations")))


#: Prefixes as lists of digests, nodes by grouping them, subtrees by joining nodes with the prefixes of nodes below.
ORACLE_SQL = r"""
WITH bits AS (SELECT b, list_reduce([b] || range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS crc FROM range(256) t(b)),
codes AS (SELECT list(crc::BIGINT ORDER BY b) AS code FROM bits),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'d': sha256(strlen(role) || ':' || role || text), 'w': len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))} ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text)) AS turns FROM t GROUP BY 1),
h AS (SELECT conv_id, turns, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT),
 lambda c, x: xor(c >> 8, code[(xor(c, x) & 255) + 1])), 4294967295::BIGINT) % 4 AS h FROM own CROSS JOIN codes),
s AS (SELECT c.conv_id, coalesce(b.turns[1:c.h], []) || c.turns[c.h + 1:] AS turns FROM h c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, d, len(turns) AS n, array_to_string(list_transform(turns[1:d], lambda x: x.d), ',') AS k, CASE WHEN d = 0 THEN '' ELSE array_to_string(list_transform(turns[1:d - 1], lambda x: x.d), ',') END AS up,
 CASE WHEN d = 0 THEN 0 ELSE turns[d].w END AS w FROM s, unnest(range(len(turns) + 1)) u(d)),
nodes AS (SELECT k, any_value(up) AS up, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY k, d),
kids AS (SELECT up, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
full_nodes AS (SELECT nodes.*, coalesce(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids ON kids.up = nodes.k AND kids.d = nodes.d),
reach AS (SELECT array_to_string(string_split(k, ',')[1:a], ',') AS k, a AS d, CASE WHEN n_children = 0 THEN 1 ELSE 0 END AS leaf, (n_convs - 1) * w AS saved FROM full_nodes, unnest(range(d + 1)) u(a)),
sums AS (SELECT k, d, sum(leaf) AS n_leaves, sum(saved) AS saved FROM reach GROUP BY ALL)
SELECT n.conv_id, n.d::BIGINT AS depth, up.conv_id AS parent_conv_id, n.n_convs, n.n_children, sums.n_leaves::BIGINT AS n_leaves, sums.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM full_nodes n JOIN sums ON sums.k = n.k AND sums.d = n.d LEFT JOIN nodes up ON n.d > 0 AND up.k = n.up AND up.d = n.d - 1
"""
