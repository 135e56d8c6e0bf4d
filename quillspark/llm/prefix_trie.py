"""The prefix trie of conversations: what a server that caches prefixes would share.

A node is a distinct sequence of first turns; its members are the conversations that begin with it.

1. A turn is told by a digest of role and text (md5, 128 bits) and the code points of its text; a conversation is the row of its turns'
   digests. Equal conversations are aggregated before anything else moves: one path with a number of members and the smallest id.
2. Paths are dealt out by hash of their first turn's digest. A first turn whose paths hold more than ``limit`` turns (without one: more
   than a partition on average) is dealt out by the next turn as well, and so on, until every subtrie fits; what stands above such subtries are a few nodes.
3. In ``applyInPandas`` each bucket's paths become tries of dictionaries that point from a digest to a node. An iterative walk, children
   before parents, sums leaves and savings.
4. The nodes above the subtries, the root among them, are aggregated level by level from the subtries' tops.
5. Members that end in a node are listed in chunks of ids, each made by a task of its own; a digest runs over a node's chunks in order,
   so no list of members is ever whole in memory.

Turns stand in the order of their number, null first; turns of one number in the order of their digests. A null role or text is empty.
Rows without conv_id belong to no conversation and are left out; repeated rows are repeated turns. Other columns are not read. A table
without conversations has no nodes, not even a root. A conversation's digests are one row (40 bytes a turn), and up to ``few`` different
conversations with one beginning, however long, are built in one task. A beginning that more of them share is divided turn by turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import bounded_batches

#: Turns of a subtrie that one task builds at most, and those that are never too many; the most nodes that are split: a larger
#: input has larger subtries instead. Between these a subtrie may be as large as a partition is on average.
LIMIT, LEAST, SPLIT = 100_000, 1000, 1_000_000
#: Different conversations below a node up to which it is never split: their next turns would hardly divide them.
FEW = 64
#: Ids of a chunk share all bits but these.
CHUNK_BITS = 12
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def conversation_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, digests array<string>, chars array<int>: one row for each conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    rows = df.filter(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), digest.alias("d"), F.length(text).alias("n")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.col("t.d").alias("digests"), F.col("t.n").alias("chars"))


def rebuilt(turns: DataFrame, share: int = 100, most: int = 6) -> DataFrame:
    """The registered query's conversations: the first h turns of conversation c - c % ``share``, then c's own after its first h, h = crc32(c) % ``most``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    lead = F.col("conv_id") - F.col("conv_id") % share
    heads = turns.filter(F.col("conv_id") % share == 0).select(F.col("conv_id").alias("lead"), F.slice("digests", 1, most - 1).alias("d"), F.slice("chars", 1, most - 1).alias("n"))
    both = turns.select("*", lead.alias("lead"), h.alias("h")).join(heads, "lead", "left")
    spliced = lambda head, own: F.concat(F.slice(F.coalesce(F.col(head), F.slice(F.col(own), 1, 0)), F.lit(1), F.col("h")), F.slice(F.col(own), F.col("h") + 1, F.greatest(F.size(own), F.lit(1))))
    return both.select("conv_id", spliced("d", "digests").alias("digests"), spliced("n", "chars").alias("chars"))


def prefix_key(level: int | Column) -> Column:
    """The digest of the first ``level`` turns."""
    return F.md5(F.array_join(F.slice("digests", F.lit(1), F.lit(level)), "").cast("binary"))


def _running_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, ends_sha256) from rows sorted by path and chunk: one digest runs on until the path changes."""
    now, running = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([running.hexdigest()], pa.string())], ["path", "ends_sha256"])

    for batch in batches:
        for path, ids in zip(batch.column("path").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if path != now:
                if running:
                    yield told()
                now, running = path, hashlib.sha256(ids.encode())
            else:
                running.update(f",{ids}".encode())
    if running:
        yield told()


def distinct_paths(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """path, digests, chars, n, least, ends_sha256: one row for each different conversation."""
    keyed = turns.withColumn("path", F.md5(F.array_join("digests", "").cast("binary")))
    paths = scratch.keep(keyed.groupBy("path").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.any_value("digests").alias("digests"), F.any_value("chars").alias("chars")), "paths")
    several = paths.filter("n > 1").select("path")
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    chunks = keyed.select("path", "conv_id").groupBy("path", chunk.alias("chunk")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids")).join(several, "path", "left_semi")
    ends = chunks.select("path", "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids")).repartition("path").sortWithinPartitions("path", "chunk").mapInArrow(_running_digests, "path string, ends_sha256 string")
    return scratch.keep(paths.join(ends, "path", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.col("least").cast("string").cast("binary"), 256))), "ended")


def _subtries(rows: pd.DataFrame) -> pd.DataFrame:
    """The nodes of a bucket's tries; tops have ``up``, the key of the node above, and no parent yet."""
    tops: dict[tuple[int, str], int] = {}
    pointers: list[dict[str, int]] = []
    depth, parent, n, least, chars, ends, up = [], [], [], [], [], [], []

    def node(at: int, above: int, size: int, key: str | None) -> int:
        for values, x in ((pointers, {}), (depth, at), (parent, above), (n, 0), (least, None), (chars, size), (ends, EMPTY_SHA256), (up, key)):
            values.append(x)
        return len(depth) - 1

    for row in rows.itertuples(index=False):
        v = tops.get((row.level, row.key))
        if v is None:
            v = tops[row.level, row.key] = node(row.level, -1, int(row.chars[row.level - 1]), row.up)
        at = row.level
        while True:
            n[v] += row.n
            least[v] = row.least if least[v] is None else min(least[v], row.least)
            if at == len(row.digests):
                break
            step = row.digests[at]
            below = pointers[v].get(step)
            if below is None:
                below = pointers[v][step] = node(at + 1, v, int(row.chars[at]), None)
            v, at = below, at + 1
        ends[v] = row.ends_sha256
    leaves, saved = [0] * len(depth), [0] * len(depth)
    walk = [(v, False) for v in tops.values()]
    while walk:
        v, seen = walk.pop()
        if not seen:
            walk.append((v, True))
            walk += [(c, False) for c in pointers[v].values()]
            continue
        leaves[v] = sum(leaves[c] for c in pointers[v].values()) or 1
        saved[v] = (n[v] - 1) * chars[v] + sum(saved[c] for c in pointers[v].values())
    above = pd.array([least[p] if p >= 0 else None for p in parent], "Int64")
    return pd.DataFrame({"conv_id": least, "depth": depth, "parent_conv_id": above, "n_convs": n, "n_children": list(map(len, pointers)), "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": ends, "up": up})


def prefix_trie(turns: DataFrame, limit: int | None = None, few: int = FEW) -> DataFrame:
    """One row for each node (see ``NODE``): conv_id is its smallest member, whose turn ``depth`` is the node's last.

    ``turns`` is what ``conversation_turns`` gives. n_leaves counts the childless nodes of the subtree, saved_tokens sums
    (n_convs - 1) times the last turn's code points over it, and ends_sha256 digests the ids of members that end here.
    """
    spark = turns.sparkSession
    bounded_batches(spark)
    with Scratch(spark) as scratch:
        paths = distinct_paths(turns, scratch)
        total = paths.agg(F.sum(F.size("digests"))).first()[0] or 0
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        limit = max(limit or min(LIMIT, max(LEAST, total // parts)), total // SPLIT)
        rest, dealt, split, ended, level = paths.filter(F.size("digests") > 0), [], [], [paths.filter(F.size("digests") == 0).withColumn("key", prefix_key(0))], 1
        while True:
            keyed = rest.select("*", prefix_key(level).alias("key"), prefix_key(level - 1).alias("up"), F.lit(level).alias("level"))
            weight = F.sum(F.size("digests") - (level - 1))
            big = keyed.groupBy("key").agg(weight.alias("weight"), F.any_value("up").alias("up"), F.any_value(F.col("chars")[level - 1]).alias("size"), F.count("*").alias("paths")).filter((F.col("weight") > limit) & (F.col("paths") > few)).drop("paths")
            big = scratch.keep(big, "split")
            if big.isEmpty():
                dealt.append(keyed)
                break
            # not more than SPLIT keys have so much weight
            keys = F.broadcast(big.select("key"))
            dealt.append(keyed.join(keys, "key", "left_anti"))
            over = keyed.join(keys, "key", "left_semi")
            split.append(big)
            ended.append(over.filter(F.size("digests") == level))
            rest = scratch.keep(over.filter(F.size("digests") > level).select(*paths.columns), "rest")
            level += 1
        rows = dealt[0]
        for part in dealt[1:]:
            rows = rows.unionByName(part)
        buckets = max(parts, -(-total // limit))
        bucketed = rows.select("level", "key", "up", "digests", "chars", "n", "least", "ends_sha256", F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
        below = scratch.keep(bucketed.groupBy("bucket").applyInPandas(lambda rows: _subtries(rows), f"{NODE}, up string"), "subtries")
        # the nodes above the subtries, from the deepest level to the root
        upper = None
        for at in range(level - 1, -1, -1):
            tops = below.filter((F.col("depth") == at + 1) & F.col("up").isNotNull())
            if upper is not None:
                tops = tops.unionByName(upper.filter(F.col("depth") == at + 1).select(*below.columns))
            ups = tops.select(F.col("up").alias("key"), "conv_id", "n_convs", F.lit(1).alias("child"), "n_leaves", "saved_tokens", F.lit(None).cast("string").alias("ends_sha256"))
            own = ended[at].select("key", F.col("least").alias("conv_id"), F.col("n").alias("n_convs"), F.lit(0).alias("child"), F.lit(0).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), "ends_sha256")
            made = ups.unionByName(own).groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.sum("child").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"))
            if at:
                made = made.join(F.broadcast(split[at - 1]), "key")
            else:
                made = made.withColumns({"up": F.lit(None).cast("string"), "size": F.lit(0)})
            made = made.select(
                "key",
                "conv_id",
                F.lit(at).cast("long").alias("depth"),
                F.lit(None).cast("long").alias("parent_conv_id"),
                "n_convs",
                "n_children",
                F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
                (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens"),
                F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
                "up",
            )
            made = scratch.keep(made, "upper")
            upper = made if upper is None else upper.unionByName(made)
        # one row for each split node and the root, so no more than SPLIT
        above = F.broadcast(upper.select(F.col("key").alias("up"), F.col("conv_id").alias("above")))
        nodes = below.unionByName(upper.select(*below.columns)).join(above, "up", "left")
        return scratch.result(nodes.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"), "trie")


def rebuilt_trie(df: DataFrame) -> DataFrame:
    """The registered query: the trie of the rebuilt conversations."""
    return prefix_trie(rebuilt(conversation_turns(df)))
