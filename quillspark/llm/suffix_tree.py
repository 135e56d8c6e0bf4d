"""Exact removal of repeated passages of words, by suffix trees that are partitioned by prefixes of variable length.

A word goes if a window of ``length`` consecutive words covers it whose word sequence also starts in a document with a smaller id.

1. Exact copies of a whole text are settled by digest: only the row with the smallest id of each goes further.
2. A window is filed under one suffix in it, the one that begins with the least hash among its first half's grams, so equal windows
   are filed alike, and about one suffix in thirteen is needed. All windows under a suffix hold its first ``deep`` words. A suffix's path is
   the hashes of its first 8, 14 and ``deep`` words, 16 bits each. A piece of the corpus sends each of its paths once, no text; paths
   that only one text has are dropped.
3. Prefixes of variable length split the suffixes into groups that fit in memory: by the first hash of the path; where more than
   ``group_places`` suffixes share it, by the first two; and then by all three. The lists of such prefixes are of bounded size, since few can have so many suffixes.
4. The passages around the suffixes (all windows filed under one) go to their group's bucket, equal passages of a piece once. A task sorts
   the suffixes of all windows of a bucket, and builds the subtree's internal nodes from neighbours' common prefixes. Nodes at ``length``
   words or deeper are the maximal repeats; the topmost of them gives its leaves their smallest id. A path with one passage is a leaf that repeats as a whole.
5. The task tells every place of a passage which of its windows to remove.
6. Where even ``deep`` words leave too many suffixes, prefixes are ``length`` words long: windows are aggregated one by one to
   their smallest id before they are shuffled, so a passage of a third of all texts meets in no single task.

Null and empty texts have no words. Rows with a null id keep all their words and remove none. Windows belong to a row's text, not to its
id alone: rows that share an id but not the text are treated each by its own words, and none removes from another; equal rows have
equal results. Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import bounded_batches, bytes_of, pieces, sha256
from .suffix_dedup import PIECE_BYTES, _bounds, _by_bucket, _from_six, _mix, _postings, _shared, removed_runs

#: Words of the gram that chooses a suffix, and of the second prefix.
GRAM, SECOND = 8, 14
#: Suffixes of a group; prefixes that are listed as larger at most: a larger input has larger groups instead.
GROUP_PLACES, LISTED = 20_000, 4_000_000
#: Bytes of passages in a bucket, about, and starts of windows in one tree.
BUCKET_BYTES, TREE_STARTS = 16 << 20, 200_000
_P = np.uint64(0xD6E8FEB86659FD93)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each word; each distinct one is hashed once."""
    coded = words.dictionary_encode()
    one = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    return one[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)


def _rolled(h: np.ndarray, size: int) -> np.ndarray:
    """The hash of the ``size`` items from each position on (short by size - 1), from hashes of powers of two."""
    n = max(len(h) - size + 1, 0)
    out, done, power, span = np.zeros(n, np.uint64), 0, h, 1
    while n and done < size:
        if size & span:
            out = out * np.uint64(pow(int(_P), span, 1 << 64)) + power[done : done + n]
            done += span
        if span * 2 <= size:
            power = power[:-span] * np.uint64(pow(int(_P), span, 1 << 64)) + power[span:]
        span *= 2
    return _mix(out)


class Windows:
    """Words of some texts, and the suffixes that their windows are filed under: owner, path, first and last window (within the text)."""

    def __init__(self, texts: list[bytes], length: int):
        words = [t.split() for t in texts]
        self.words = words
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes)
        first, deep = length // 2, length - length // 2 + 1  # windows' offsets of the suffix are below ``first``
        gram = min(GRAM, deep)
        none = np.zeros(0, np.int64)
        self.owner, self.path, self.begin, self.last = none, none.astype(np.uint64), none, none
        long = np.flatnonzero(sizes >= length)
        if not len(long):
            return
        h = word_hashes(pa.array([w for t in words for w in t], pa.large_binary()))
        grams = _rolled(h, gram)
        low = np.uint64((1 << 28) - 1)
        if len(h) > int(low):
            raise ValueError("a piece of more than 2^28 words")
        least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        span, n = 1, len(h) - length + 1
        while span * 2 <= first:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        least = np.minimum(least[:n], least[first - span : first - span + n])
        starts = np.concatenate([np.arange(ends[i] - sizes[i], ends[i] - length + 1) for i in long.tolist()])
        place = (least[starts] & low).astype(np.int64)
        owner = np.repeat(long, sizes[long] - length + 1)
        fresh = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])]))
        place, self.owner = place[fresh], owner[fresh]
        base = (ends - sizes)[self.owner]
        self.begin = starts[fresh] - base
        self.last = starts[np.append(fresh[1:], len(starts)) - 1] - base
        second, whole = _rolled(h, min(SECOND, deep))[place], _rolled(h, deep)[place]
        top = lambda x, at: (x >> np.uint64(48)) << np.uint64(at)
        self.path = top(grams[place], 48) | top(second, 32) | top(whole, 16) | (whole & np.uint64(0xFFFF))


def filed(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, nothing, path, first window), as ``_postings`` asks."""
    w = Windows(texts, length)
    return w.owner, w.begin, w.path, w.begin


class Subtree:
    """The internal nodes, ``depth`` words or deeper, of the tree of some suffixes of strings of words.

    ``order`` has the suffixes (numbers of ``starts``) as the leaves stand; ``nodes`` are (depth, first leaf, last leaf), parents before children,
    where depths are told up to the shorter string's end. ``top`` numbers the leaves by their topmost such node, -1 where there is none.
    """

    def __init__(self, words: np.ndarray, string: np.ndarray, starts: np.ndarray, depth: int, nodes: bool = True):
        n = len(words)
        ends = np.flatnonzero(np.append(string[1:] != string[:-1], True)) + 1 if n else np.zeros(0, np.int64)
        left = ends[string] - np.arange(n) if n else ends
        # ranks by 1, 2, 4.. words; what is short of them has the end mark in it, and stands first
        rank, ranks, span = words.astype(np.int64) + 1, [], 1
        # whole order for nodes; else the largest power of two within ``depth``
        enough = 2 * int(left.max(initial=1)) if nodes else depth
        while True:
            ranks.append(rank)
            if span * 2 > enough:
                break
            ahead = np.zeros(n, np.int64)
            inside = np.flatnonzero(left > span)
            ahead[inside] = rank[inside + span]
            key = (rank << np.int64(31)) | ahead
            order = np.argsort(key)
            by = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], by[1:] != by[:-1]])) + 1
            span *= 2
        self.ranks, self.left = ranks, left
        # by the first ``depth`` words: two spans that overlap
        tail = np.minimum(starts + depth - span, n - 1) if span < depth else starts
        full = left[starts] >= depth
        key = np.where(full, (rank[starts] << np.int64(31)) | rank[tail], -1)
        if nodes:
            key = rank[starts]
        self.order = np.argsort(key, kind="stable")
        s = starts[self.order]
        if nodes:
            self.common = self._common(s[:-1], s[1:])
            together = self.common >= depth
        else:
            by = key[self.order]
            together = (by[1:] == by[:-1]) & (by[1:] >= 0)
        heads = np.concatenate([[True], ~together]) if len(s) else np.zeros(0, bool)
        number = np.cumsum(heads) - 1
        size = np.bincount(number, minlength=1)
        self.top = np.where(size[number] > 1, number, -1) if len(s) else number
        self.nodes = self._nodes(depth) if nodes else []

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The common prefixes of pairs of suffixes, from the longest span to the shortest."""
        out = np.zeros(len(a), np.int64)
        room = np.minimum(self.left[a], self.left[b])
        for k in range(len(self.ranks) - 1, -1, -1):
            fits = out + (1 << k) <= room
            x, y = np.where(fits, a + out, 0), np.where(fits, b + out, 0)
            out += np.where(fits & (self.ranks[k][x] == self.ranks[k][y]), 1 << k, 0)
        return out

    def _nodes(self, depth: int) -> list[tuple[int, int, int]]:
        """One walk over the common prefixes; the stack holds the path of open nodes."""
        found, stack = [], []
        for i, c in enumerate([*self.common.tolist(), 0]):
            first = i
            while stack and stack[-1][0] > c:
                d, first = stack.pop()
                found.append((d, first, i))
            if c >= depth and (not stack or stack[-1][0] < c):
                stack.append((c, first))
        return sorted(found, key=lambda x: (x[1], -x[2], x[0]))


def maximal_repeats(texts: list[bytes], depth: int) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """The repeats of ``depth`` words or more that some texts have, each with its places (text, word): the deep nodes of one tree.

    A node's words cannot be continued to the right alike at all its places; such as can be to the left are left out.
    """
    words = [t.split() for t in texts]
    flat = pa.array([w for t in words for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy()
    string = np.repeat(np.arange(len(words)), list(map(len, words)))
    base = np.cumsum([0, *map(len, words)])
    tree = Subtree(flat, np.unique(string, return_inverse=True)[1], np.arange(len(flat)), depth)
    out = []
    for d, a, b in tree.nodes:
        at = tree.order[a : b + 1]
        before = {-1 - int(i) if i == base[string[i]] else int(flat[i - 1]) for i in at}
        if len(before) > 1:
            places = sorted((int(string[i]), int(i - base[string[i]])) for i in at)
            t, i = places[0]
            out.append((b" ".join(words[t][i : i + d]), places))
    return out


def _passages(batches: Iterator[pa.RecordBatch], length: int, buckets: int, lists: list[np.ndarray], windows: bool) -> Iterator[pa.RecordBatch]:
    """The passages around the suffixes that were told to be shared, equal ones of a piece once, packed by bucket; or, of suffixes whose
    path is on the last list, every window by itself."""
    for batch in batches:
        for part in pieces(batch, limit=PIECE_BYTES):
            w = Windows(bytes_of(part), length)
            short = w.path >> np.uint64(16)
            wanted = np.zeros(len(short), bool)
            bounds = np.searchsorted(w.owner, np.arange(len(w.words) + 1))
            for i, told in enumerate(part.column("grams").to_pylist()):
                a, b = bounds[i], bounds[i + 1]
                wanted[a:b] = np.isin(short[a:b], _from_six(b"".join(told)))
            wanted &= np.isin(short, lists[2]) == windows
            pick = np.flatnonzero(wanted)
            owner, short, begin, last = w.owner[pick], short[pick], w.begin[pick], w.last[pick]
            ids, keys = part.column("id").to_numpy(), part.column("t").to_numpy()
            if windows:
                n = last - begin + 1
                starts = np.repeat(begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = np.repeat(owner, n)
                data = [b" ".join(w.words[o][s : s + length]) for o, s in zip(own.tolist(), starts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), pa.array(ids[own]), pa.array(keys[own]), pa.array(starts.astype(np.int32))], ["s", "id", "t", "begin"])
                continue
            if not len(owner):
                continue
            one, two = short >> np.uint64(32), short >> np.uint64(16)
            group = np.where(~np.isin(one, lists[0]), one, np.where(~np.isin(two, lists[1]), two | np.uint64(1 << 62), short | np.uint64(1 << 63)))
            seen: dict[bytes, int] = {}
            data = [b" ".join(w.words[o][s : e + length]) for o, s, e in zip(owner.tolist(), begin.tolist(), last.tolist(), strict=True)]
            entry = np.fromiter((seen.setdefault(p, len(seen)) for p in data), np.int64, len(data))
            spans, head = list(seen), np.zeros(len(seen), np.int64)
            head[entry[::-1]] = np.arange(len(entry))[::-1]
            bucket = (_mix(group[head] * _P) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((group[head], bucket))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            at_places = np.argsort(rank[entry], kind="stable")
            places = np.bincount(rank[entry], minlength=len(order))
            ends = np.concatenate([[0], np.cumsum(places)])
            own = owner[at_places]
            place_ids, place_keys, begins = ids[own], keys[own], begin[at_places].astype(np.uint32)
            cuts, sizes, paths, rows = _bounds(bucket[order]), np.fromiter(map(len, spans), np.uint32, len(spans)), short[head], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                some, x, y = order[a:b], int(ends[a]), int(ends[b])
                rows.append((int(bucket[some[0]]), paths[some].tobytes(), sizes[some].tobytes(), pa.compress(b"".join([spans[i] for i in some.tolist()]), "zstd", asbytes=True), places[a:b].astype(np.uint32).tobytes(), place_ids[x:y].tobytes(), place_keys[x:y].tobytes(), begins[x:y].tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", "paths", "sizes", "passages", "places", "ids", "keys", "begins"])


def least_ids(passages: list[bytes], ids: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts): for every window of each passage the smallest id of a passage that has the same window; and how many windows each has."""
    words = [p.split() for p in passages]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = pa.array([w for t in words for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy()
    string = np.repeat(np.arange(len(words)), sizes)
    starts = np.maximum(sizes - length + 1, 0)
    at = np.repeat(np.cumsum(sizes) - sizes, starts) + np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts)
    tree = Subtree(flat, string, at, length, nodes=False)
    least = np.full(int(tree.top.max(initial=-1)) + 1, np.iinfo(np.int64).max)
    owner = string[at]
    held = tree.top >= 0
    np.minimum.at(least, tree.top[held], ids[owner[tree.order[held]]])
    out = ids[owner]
    out[tree.order[held]] = least[tree.top[held]]
    return out, starts


def _solved(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For each text of a bucket, the ranges of windows to remove: (id, t, a, b), ``b`` past the last."""
    for rows in _by_bucket(batches):
        read = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])  # noqa: E731, B023
        paths, places = read("paths", np.uint64), read("places", np.uint32).astype(np.int64)
        ids, keys, begins = read("ids", np.int64), read("keys", np.int64), read("begins", np.uint32).astype(np.int64)
        seen: dict[tuple[int, bytes], int] = {}
        entry, done = [], 0
        for r in rows:
            sizes, at = np.frombuffer(r["sizes"], np.uint32).tolist(), 0
            data = pa.decompress(r["passages"], sum(sizes), "zstd", asbytes=True)
            for path, n in zip(paths[done : done + len(sizes)].tolist(), sizes, strict=True):
                entry.append(seen.setdefault((path, data[at : at + n]), len(seen)))
                at += n
            done += len(sizes)
        passages, path = [p for _, p in seen], np.fromiter((k for k, _ in seen), np.uint64, len(seen))
        of_place = np.repeat(np.array(entry, np.int64), places)
        least = np.full(len(passages), np.iinfo(np.int64).max)
        np.minimum.at(least, of_place, ids)
        starts = np.fromiter((p.count(b" ") for p in passages), np.int64, len(passages)) + 2 - length
        _, which, forms = np.unique(path, return_inverse=True, return_counts=True)
        several = np.flatnonzero(forms[which] > 1)
        single = np.flatnonzero(forms[which] == 1)
        # runs of windows with one answer: passage, from, to, smallest id
        told = [(single, np.zeros(len(single), np.int64), starts[single], least[single])]
        if len(several):
            # whole paths in the order of their prefixes, as many as make a tree
            several = several[np.argsort(path[several], kind="stable")]
            tree = (np.cumsum(starts[several]) - starts[several]) // TREE_STARTS
            first = np.concatenate([[True], path[several][1:] != path[several][:-1]])
            tree = tree[np.flatnonzero(first)][np.cumsum(first) - 1]
            cuts = _bounds(tree)
            flat = np.concatenate([least_ids([passages[i] for i in several[a:b].tolist()], least[several[a:b]], length)[0] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)])
            owner = np.repeat(several, starts[several])
            head = np.flatnonzero(np.concatenate([[True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])]))
            base = np.repeat(np.cumsum(starts[several]) - starts[several], starts[several])
            told.append((owner[head], head - base[head], np.append(head[1:], len(flat)) - base[head], flat[head]))
        run_p, run_a, run_b, run_id = (np.concatenate(x) for x in zip(*told, strict=True))
        order = np.argsort(run_p, kind="stable")
        run_a, run_b, run_id = run_a[order], run_b[order], run_id[order]
        per = np.bincount(run_p, minlength=len(passages))
        ahead = np.cumsum(per) - per
        n = per[of_place]
        place = np.repeat(np.arange(len(of_place)), n)
        run = np.repeat(ahead[of_place], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = run_id[run] < ids[place]
        place, run = place[gone], run[gone]
        if not len(place):
            continue
        order = np.lexsort((keys[place], ids[place]))
        place, run = place[order], run[order]
        i, k, a, b = ids[place], keys[place], (begins[place] + run_a[run]).astype(np.int32), (begins[place] + run_b[run]).astype(np.int32)
        cuts = np.concatenate([[0], np.flatnonzero((i[1:] != i[:-1]) | (k[1:] != k[:-1])) + 1, [len(i)]])
        offsets = pa.array(cuts.astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(i[cuts[:-1]]), pa.array(k[cuts[:-1]]), pa.ListArray.from_arrays(offsets, pa.array(a)), pa.ListArray.from_arrays(offsets, pa.array(b))], ["id", "t", "a", "b"])


def _prefix_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(level, prefix, n): how many suffixes of a batch's texts begin with each prefix."""
    for batch in batches:
        paths = _from_six(b"".join(batch.column("grams").to_pylist()))
        for level, shift in enumerate((32, 16, 0)):
            prefix, n = np.unique(paths >> np.uint64(shift), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), level, np.int32)), pa.array(prefix.astype(np.int64)), pa.array(n)], ["level", "prefix", "n"])


def window_repeats(rows: DataFrame, firsts: DataFrame, scratch: Scratch, length: int, group_places: int, parts: int | None = None) -> DataFrame:
    """(id, t, ranges array<struct<a array<int>, b array<int>>>): for each text its ranges of windows to remove.

    ``rows`` has id, text, t (the text's 64-bit key) and digest; ``firsts`` the smallest id of each text, and ``which``, its key if
    the id has other texts too, else 0: that is the t of the answer.
    """
    spark = rows.sparkSession
    parts = parts or max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with Scratch(spark) as early:
        packed = rows.select("t", "text").mapInArrow(lambda it: _postings(it, length, parts * 4, filed), "bucket long, keys binary, counts binary, grams binary, known binary")
        # no gram is hot here: what is too frequent is told by the counts of prefixes
        told = early.keep(packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _shared(it, 1 << 62), "t long, grams binary, n long").select("t", "grams"), "told")
        total = told.agg(F.sum(F.octet_length("grams") / 6)).first()[0] or 0
        group_places = max(group_places, int(total) // LISTED)
        counts = told.select("grams").mapInArrow(_prefix_counts, "level int, prefix long, n long").groupBy("level", "prefix").agg(F.sum("n").alias("n"))
        # a level has no more than LISTED such prefixes
        over = counts.filter(F.col("n") > group_places).select("level", "prefix").toArrow()
        levels, prefixes = over.column("level").to_numpy(), over.column("prefix").to_numpy().astype(np.uint64)
        lists = spark.sparkContext.broadcast([np.sort(prefixes[levels == k]) for k in range(3)])
        spots = told.groupBy("t").agg(F.collect_list("grams").alias("grams"))
        chosen = rows.drop("t").join(firsts.join(spots, "t").select("id", "digest", F.col("which").alias("t"), "grams"), ["id", "digest"]).select("id", "t", "text", "grams")
        buckets = max(parts, int(total) * length * 8 // BUCKET_BYTES)
        found = chosen.mapInArrow(lambda it: _passages(it, length, buckets, lists.value, False), "bucket long, paths binary, sizes binary, passages binary, places binary, ids binary, keys binary, begins binary")
        ranges = found.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _solved(it, length), "id long, t long, a array<int>, b array<int>")
        if (levels == 2).any():
            strings = scratch.keep(chosen.mapInArrow(lambda it: _passages(it, length, buckets, lists.value, True), "s binary, id long, t long, begin int"), "windows")
            least = strings.groupBy("s").agg(F.min("id").alias("least"))
            gone = strings.join(least, "s").filter(F.col("least") < F.col("id"))
            ranges = ranges.unionByName(gone.groupBy("id", "t").agg(F.collect_list("begin").alias("a"), F.collect_list((F.col("begin") + 1).cast("int")).alias("b")))
        return scratch.keep(ranges.groupBy("id", "t").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "ranges")


def repeats_removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, group_places: int = GROUP_PLACES) -> DataFrame:
    """doc_id, n_words, removed array<struct<start, stop>> (runs of words that go), kept (what stays, joined by one space) of every row."""
    bounded_batches(df.sparkSession)
    with Scratch(df.sparkSession) as scratch:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        every = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text").alias("t"), F.unhex(F.sha2("text", 256)).alias("digest"))
        # so many words take twice as many bytes, but for one
        rows = every.filter(F.col("id").isNotNull() & (F.octet_length("text") >= 2 * length - 1))
        firsts = scratch.keep(rows.groupBy("digest", "t").agg(F.min("id").alias("id")), "leads")
        shared = firsts.groupBy("id").agg((F.count("*") > 1).alias("shared")).filter("shared")
        firsts = scratch.keep(firsts.join(shared, "id", "left").withColumn("which", F.when(F.col("shared"), F.col("t")).otherwise(F.lit(0).cast("long"))).drop("shared"), "firsts")
        ranges = window_repeats(rows, firsts, scratch, length, group_places)
        # a row is first of its text if its id is the digest's smallest; else it is a copy and goes as a whole
        answers = firsts.drop("t").withColumnRenamed("which", "t").join(ranges, ["id", "t"], "left").select("id", "digest", "ranges", F.lit(True).alias("first"))
        mine = every.join(answers, ["id", "digest"], "left").select("id", "text", "ranges", "first")
        kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in pieces(batch):
                    ids, sizes, gone, left = part.column("id").to_pylist(), [], [], []
                    for doc, data, told, first in zip(ids, bytes_of(part), part.column("ranges").to_pylist(), part.column("first").to_pylist(), strict=True):
                        words = data.split()
                        if doc is not None and not first:
                            runs = [(0, len(words))] if len(words) >= length else []
                        else:
                            runs = removed_runs([x for r in told or [] for x in zip(r["a"], r["b"], strict=True)], length)
                        sizes.append(len(words))
                        gone.append([{"start": a, "stop": b} for a, b in runs])
                        for a, b in reversed(runs):
                            del words[a:b]
                        left.append(b" ".join(words))
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(gone, kind), pa.array(left, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "removed", "kept"])

        return scratch.result(mine.mapInArrow(run, "doc_id long, n_words long, removed array<struct<start:long,stop:long>>, kept string"), "kept")


def substring_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The registered query: counts and digests of what stays."""
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["stop"] - r["start"])
    return repeats_removed(df, id_col, text_col).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
