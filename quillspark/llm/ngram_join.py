"""N-gram Jaccard self-join: documents linked when their word-shingle sets overlap enough.

The join is a T-occurrence search: every document is a query against inverted lists from
shingle to documents, and wants the documents that occur on at least T of its lists. As in
DivideSkip, a query's lists are divided: the shortest are merged, the long ones are only
probed by binary search for the few documents that the merge brings up.

How it is laid out on Spark:

1. ``_sets`` maps each text to its shingles (64-bit hashes of the words), in one narrow pass.
   Equal sets are one class from here on, so exact copies cost nothing further.
2. A bounded sketch of shingle counts (2**20 counters, summed over the whole corpus) gives one
   global order from rare to common. Linked sets of n shingles share one of each one's
   n - ceil(t n) + 1 rarest, so only those "short list" postings are shuffled; the smaller of two by even fewer of its
   own (``is_led``), so lists without such a posting are dropped.
3. On each list, sorted by set size, every class is tied to the one before it and to the first in reach of
   its size: ties are linear in postings. A tie stays only if parity bitmaps of the two sets (one
   bit for each shingle's hash, bits flipped) differ in no more bits than linked sets can: a sound
   test, as each shingle in one set only flips one bit. Components of ties are collapsed; only
   classes of different components on one list are still compared, by short bitmaps that their postings
   carry. Pairs that pass are joined inside the task, and a list gives one tie between components for each joining:
   fewer than it has components. What all ties join are neighbourhoods: every link lies inside one.
4. Neighbourhoods are searched with full sets, by DivideSkip. One that holds more than
   ``block_shingles`` is dealt out: blocks of bounded size, and a task for each pair of blocks whose
   sizes can match; so no task ever holds more than two blocks, and no link is lost.
5. Links of blocks are joined by connected components; members get their class's answer.

A text without words has an empty set and links to nothing. Null is the empty text. Repeated ids
give one row for each input row.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.components import connected_components
from ..session import Scratch
from .common import bounded_batches, bytes_of, mapped, row_key, without_rows

SKETCH_BITS = 20
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _byte_values() -> np.ndarray:
    """A random odd value for each byte; A-Z as a-z, white space 0."""
    values = _mix(np.arange(1, 257, dtype=np.uint64) * _MULT) | np.uint64(1)
    values[65:91] = values[97:123]
    values[[32, *range(9, 14)]] = 0
    return values


_VALUES = _byte_values()
_SALTS = np.arange(1, 65, dtype=np.uint64) * _MULT
_POWERS = np.cumprod(np.full(4096, 0xD6E8FEB86659FD93, np.uint64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words in each text): words are runs of bytes other than white space."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    values = _VALUES[data]
    inside = values != 0
    edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    text_ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    per_text = np.diff(np.concatenate([[0], np.searchsorted(starts, text_ends)]))
    if not len(starts):
        return np.zeros(0, np.uint64), per_text
    place = np.arange(len(data)) - np.repeat(np.concatenate([[0], starts]), np.diff(np.concatenate([[0], starts, [len(data)]])))
    longest = int((ends - starts).max())
    powers = _POWERS if longest <= len(_POWERS) else np.cumprod(np.full(longest, 0xD6E8FEB86659FD93, np.uint64))
    weighed = values * powers[np.minimum(place, len(powers) - 1)]
    return _mix(np.add.reduceat(weighed, starts) ^ (ends - starts).astype(np.uint64)), per_text


def shingle_sets(texts: list[bytes], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    hashes, per_text = word_hashes(texts)
    n = len(hashes)
    rolled = np.zeros(n, np.uint64)
    for k in range(words):
        if n > k:
            rolled[: n - k] += _mix(hashes[k:] + _SALTS[k])
    rolled = _mix(rolled)
    out, at = [], 0
    for m in per_text.tolist():
        if m >= words:
            out.append(np.unique(rolled[at : at + m - words + 1]))
        elif m:
            short = hashes[at : at + m] + np.arange(1, m + 1, dtype=np.uint64) * _MULT
            out.append(_mix(np.array([_mix(short).sum() ^ np.uint64(m)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


#: Most bits of the bitmap that a posting carries.
BRIEF_BITS = 4096


def parity_bits(s: np.ndarray, size: int | None = None) -> np.ndarray:
    """A bitmap of twice to four times as many bits as shingles (64 at least), or of ``size`` bits, each shingle flipping one bit."""
    size = size or max(64, 1 << int(2 * max(1, len(s)) - 1).bit_length())
    flips = np.bincount((_mix(s) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def brief_bits(s: np.ndarray) -> np.ndarray:
    """A bitmap of one to two times as many bits as shingles, from 64 up to BRIEF_BITS: sets within reach differ at most by one halving."""
    return parity_bits(s, min(BRIEF_BITS, max(64, 1 << int(max(1, len(s)) - 1).bit_length())))


def may_link(n1: Column, bits1: Column, n2: Column, bits2: Column, num: int, den: int) -> Column:
    """False only if two sets cannot link: by their sizes, or as their bitmaps differ in more bits than linked sets can.

    Linked sets differ in at most (n1 + n2) (1 - t) / (1 + t) shingles. The longer bitmap is folded onto the shorter,
    which keeps parities.
    """
    fold = lambda b: F.zip_with(F.slice(b, 1, (F.size(b) / 2).cast("int")), F.slice(b, (F.size(b) / 2).cast("int") + 1, (F.size(b) / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))
    a = F.when(F.size(bits1) > F.size(bits2), fold(bits1)).otherwise(bits1)
    b = F.when(F.size(bits2) > F.size(bits1), fold(bits2)).otherwise(bits2)
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    sizes = (n1 * den >= n2 * num) & (n2 * den >= n1 * num)
    return sizes & (differ * (den + num) <= (n1 + n2) * (den - num))


def _tested(ties: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The ties (a, b) that may be links: first by the short bitmaps, which are less to move, then by the long ones."""
    for bits in ("brief", "bits"):
        side = lambda x, bits=bits: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col(bits).alias(f"bits_{x}"))
        both = ties.join(side("a"), "a").join(side("b"), "b")
        ties = both.filter(may_link(F.col("n_a"), F.col("bits_a"), F.col("n_b"), F.col("bits_b"), num, den)).select("a", "b")
    return ties


def _pass(n: np.ndarray, words: np.ndarray, starts: np.ndarray, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which pairs of places (i before j, so no larger) may link by their bitmaps: the test of ``may_link`` in numpy."""
    sizes = np.diff(starts)
    out = np.zeros(len(i), bool)
    for w in np.unique(sizes[i]).tolist():
        own = np.flatnonzero(sizes[i] == w)
        for cut in range(0, len(own), 1 << 15):
            pick = own[cut : cut + (1 << 15)]
            a, b, along = i[pick], j[pick], np.arange(w)
            bits = words[starts[a][:, None] + along] ^ words[starts[b][:, None] + along]
            wide = np.flatnonzero(sizes[b] > w)  # the longer bitmap is folded
            bits[wide] ^= words[starts[b[wide]][:, None] + w + along]
            out[pick] = np.bitwise_count(bits.view(np.uint64)).sum(axis=1, dtype=np.int64) * (den + num) <= (n[a] + n[b]) * (den - num)
    return out


def _apart(batches: Iterator[pa.RecordBatch], num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows (token, unit, rep, n, led, brief) sorted by token, n and rep: ties (a, b) between the units of one list.

    Of two classes the first must be led on the list. Two units are tied if classes of theirs have sizes and bitmaps that can match, directly or through other units of
    the list; the ties of a list are a forest, so there are fewer of them than units.
    """
    names = ["token", "unit", "rep", "n", "led"]

    def pairs(token: np.ndarray, unit: np.ndarray, rep: np.ndarray, n: np.ndarray, led: np.ndarray, words: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        at, k, starts = np.flatnonzero(led), 1, np.concatenate([[0], np.cumsum(sizes)])
        label = np.unique(np.stack([token, unit]), axis=1, return_inverse=True)[1].ravel()  # of each place, its unit on its list
        parent = np.arange(len(token))

        def roots(places: np.ndarray) -> np.ndarray:
            r = parent[label[places]]
            while not np.array_equal(up := parent[r], r):
                r = up
            return r

        while len(at):  # every place against the one k further on, as long as that is on its list and within reach
            at = at[at + k < len(token)]
            at = at[(token[at] == token[at + k]) & (n[at] * den >= n[at + k] * num)]
            met = at[roots(at) != roots(at + k)]
            met = met[_pass(n, words, starts, met, met + k, num, den)]
            tied = []
            for i, x, y in zip(met.tolist(), roots(met).tolist(), roots(met + k).tolist(), strict=True):
                while parent[x] != x:
                    x = parent[x]
                while parent[y] != y:
                    y = parent[y]
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    tied.append(i)
            if tied:
                one, two = unit[tied], unit[np.array(tied) + k]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], ["a", "b"])
            k += 1

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        brief = batch.column("brief")
        cols = [*[batch.column(c).to_numpy(zero_copy_only=False) for c in names], brief.flatten().to_numpy(), np.diff(brief.offsets.to_numpy())]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last list may go on
        end = int(cols[6][:cut].sum())
        yield from pairs(*[c[:cut] for c in cols[:5]], cols[5][:end], cols[6][:cut])
        held = [*[c[cut:] for c in cols[:5]], cols[5][end:], cols[6][cut:]]
    if held is not None:
        yield from pairs(*held)


def least_overlap(n: int, num: int, den: int) -> int:
    """Shingles that a set of n shares with any set it links to: ceil(n * num / den)."""
    return -(-n * num // den)


def is_led(place: Column, n: Column, num: int, den: int) -> Column:
    """Whether a set of n must be looked up by its shingle at this place, from rare to common, for no set of its size or larger to be missed."""
    return place < n - F.ceil(n * 2 * num / (num + den)) + 1


def shingle_sketch(df: DataFrame, id_col: str, text_col: str, words: int) -> np.ndarray:
    """How often shingles occur in the corpus, by 2**20 hashed counters: summed on executors, 4 MB to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .common import pieces

        total = None
        for batch in batches:
            for part in pieces(batch):
                codes = np.concatenate(shingle_sets(bytes_of(part), words)) >> np.uint64(64 - SKETCH_BITS)
                found = np.bincount(codes.astype(np.int64), minlength=1 << SKETCH_BITS)
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())], ["part", "counts"])

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum((np.frombuffer(b, np.uint32).astype(np.int64) for b in frame["counts"]), np.zeros(1 << SKETCH_BITS, np.int64))
        return pd.DataFrame({"part": [int(frame["part"].iloc[0]) // 16], "counts": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})

    parts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "part long, counts binary")
    n = parts.rdd.getNumPartitions()
    while n > 1:  # sums of sixteen partial counts at a time
        parts = parts.groupBy(F.floor(F.col("part") / 16).alias("g")).applyInPandas(add, "part long, counts binary")
        n = -(-n // 16)
    found = parts.first()
    return np.frombuffer(found["counts"], np.uint32).astype(np.int64) if found else np.zeros(1 << SKETCH_BITS, np.int64)


def _sets(df: DataFrame, id_col: str, text_col: str, words: int, num: int, den: int, classes: np.ndarray) -> DataFrame:
    """(id, n, sig, rare, bits, brief): size and digest of each set, its rarest shingles, which any linked set shares one of, and its parity bitmaps."""
    shared = df.sparkSession.sparkContext.broadcast(classes)

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        commonness, ns, sigs, rares, maps, briefs = shared.value, [], [], [], [], []
        for s in shingle_sets(bytes_of(part), words):
            n = len(s)
            ns.append(n)
            sigs.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
            maps.append(parity_bits(s))
            briefs.append(brief_bits(s))
            keep = n - least_overlap(n, num, den) + 1 if n else 0
            if keep:
                order = np.lexsort((s, commonness[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))[:keep]
                rares.append(s[order].view(np.int64))
            else:
                rares.append(np.zeros(0, np.int64))
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rares])]).astype(np.int32)
        flat = pa.array(np.concatenate(rares) if rares else np.zeros(0, np.int64))
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(ns, pa.int64()), pa.array(sigs, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), flat), pa.array(maps, pa.list_(pa.int64())), pa.array(briefs, pa.list_(pa.int64()))], ["id", "n", "sig", "rare", "bits", "brief"])

    return mapped(df, run, "id long, n long, sig binary, rare array<long>, bits array<long>, brief array<long>", id_col, text_col)


#: Postings up to which short lists are merged by a heap. The weight of a list's logarithm in choosing how many lists are long.
HEAP_POSTINGS, LONG_LIST_COST = 1024, 0.0085


class DivideSkip:
    """T-occurrence search over the inverted lists of some sets; sets are in order of size.

    The longest lists of a query are set aside (Li, Lu and Lu, "Efficient Merging and Filtering Algorithms for Approximate
    String Searches", give their number); documents on enough of the others are looked up in each of them.
    """

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.sets, self.num, self.den = sets, num, den
        sizes = np.array([len(s) for s in sets], np.int64)
        self.sizes = sizes
        tokens = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        distinct, code = np.unique(tokens, return_inverse=True)
        order = np.argsort(code, kind="stable")
        self.lists, self.ends = owner[order], np.cumsum(np.bincount(code, minlength=len(distinct)))
        self.lengths = np.diff(np.concatenate([[0], self.ends]))
        self.code = np.split(code, np.cumsum(sizes)[:-1]) if len(sets) else []
        self.parent = list(range(len(sets)))
        self.linked = 0

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def merge_short(self, short: np.ndarray, low: int, high: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The documents from low up to, not including, high that stand on ``least`` of the short lists, and on how many, most first.

        A heap merge; where the lists hold more than HEAP_POSTINGS, they are sorted together or counted, whichever costs less: either
        follows the postings in reach, not the number of documents.
        """
        spans = [(int(self.ends[t] - self.lengths[t]), int(self.ends[t])) for t in short.tolist()]
        if sum(b - a for a, b in spans) <= HEAP_POSTINGS:
            merged = heapq.merge(*(self.lists[a:b].tolist() for a, b in spans))
            found = [(d, n) for d, own in itertools.groupby(merged) if low <= d < high and (n := sum(1 for _ in own)) >= least]
            docs, counts = np.array([d for d, _ in found], np.int64), np.array([n for _, n in found], np.int64)
        else:
            own = (self.lists[a:b] for a, b in spans)
            held = np.concatenate([x[np.searchsorted(x, low) : np.searchsorted(x, high)] for x in own])
            if len(held) * 8 < high - low:
                held.sort()
                heads = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]])) if len(held) else np.zeros(0, np.int64)
                docs, counts = held[heads], np.diff(np.append(heads, len(held)))
                docs, counts = docs[counts >= least], counts[counts >= least]
            else:
                seen = np.bincount(held - low, minlength=high - low)
                docs = np.flatnonzero(seen >= least)
                counts, docs = seen[docs], docs + low
        order = np.argsort(-counts, kind="stable")
        return docs[order], counts[order]

    def probe_long(self, long: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """On how many of the long lists each document stands, by binary search in every list."""
        begin, end = self.ends[long] - self.lengths[long], self.ends[long]
        shape = (len(docs), len(long))
        lo, hi, sought = np.broadcast_to(begin, shape).copy(), np.broadcast_to(end, shape).copy(), docs[:, None]
        for _ in range(int(self.lengths[long].max()).bit_length() if len(long) else 0):
            mid = (lo + hi) >> 1
            less = self.lists[np.minimum(mid, len(self.lists) - 1)] < sought
            np.copyto(lo, mid + 1, where=less & (lo < hi))
            np.copyto(hi, mid, where=~less & (lo < hi))
        return ((lo < end) & (self.lists[np.minimum(lo, len(self.lists) - 1)] == sought)).sum(axis=1)

    def search(self, queries: range, index_end: int | None = None) -> None:
        """Links each query with the smaller-or-equal sets before it (or before ``index_end``)."""
        for x in queries:
            n = int(self.sizes[x])
            need = least_overlap(n, self.num, self.den)  # T: what any set in reach shares with this one at least
            low = int(np.searchsorted(self.sizes, need))
            high = x if index_end is None else min(index_end, x)
            if low >= high:
                continue
            by_length = self.code[x][np.argsort(self.lengths[self.code[x]], kind="stable")]
            # divided: L long lists are only probed; a result is on T - L of the others
            skipped = min(need - 1, int(need / (LONG_LIST_COST * math.log2(int(self.lengths[by_length[-1]]) + 1) + 1)))
            short, long = by_length[: n - skipped], by_length[n - skipped :]
            docs, counts = self.merge_short(short, low, high, need - skipped)
            me, at, step = self.root(x), 0, 1
            while at < len(docs):
                # already joined: whether this very pair links changes no component
                pick = [i for i in range(at, min(at + step, len(docs))) if self.root(int(docs[i])) != me]
                at, step = at + step, min(step * 4, 256)
                if not pick:
                    continue
                some = docs[pick]
                both = counts[pick] + self.probe_long(long, some)
                for y in some[both * (self.den + self.num) >= self.num * (n + self.sizes[some])].tolist():
                    first, second = sorted((self.root(y), me))
                    self.parent[second] = first
                    me = first


def _search(batches: Iterator[pd.DataFrame], words: int, num: int, den: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by unit (neighbourhood, block pair): yields (id, label) for all members of a unit that link."""

    def done(frames: list[pd.DataFrame]) -> pd.DataFrame | None:
        unit = pd.concat(frames) if len(frames) > 1 else frames[0]
        if len(unit) < 2:
            return None
        sets = shingle_sets(unit["text"].tolist(), words)
        ids, side = unit["id"].to_numpy(), unit["side"].to_numpy()
        order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), ids[i]))
        finder = DivideSkip([sets[i] for i in order], num, den)
        finder.search(range(len(order)))
        ids = ids[order]
        roots = np.array([finder.root(i) for i in range(len(order))])
        least = pd.Series(ids).groupby(roots).transform("min").to_numpy()
        keep = least != ids
        return pd.DataFrame({"src": least[keep], "dst": ids[keep]}) if keep.any() and len(side) else None

    now, held = None, []
    for frame in batches:
        if not len(frame):
            continue
        keys = list(zip(frame["unit"], frame["pair"], strict=True))
        cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if keys[a] != now and held:
                if (out := done(held)) is not None:
                    yield out
                held = []
            now = keys[a]
            held.append(frame.iloc[a:b])
    if held and (out := done(held)) is not None:
        yield out


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, num: int = 80, den: int = 100, block_shingles: int = 2_000_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: components of links with Jaccard >= num / den.

    ``id_col`` is an integer column; component_id is the smallest id in reach. Rows with a null id are left
    out of links (their component is null). ``block_shingles`` bounds what a task holds of a neighbourhood.
    """
    spark = df.sparkSession
    bounded_batches(spark)
    with Scratch(spark) as scratch:
        counts = shingle_sketch(df, id_col, text_col, words)
        mean = max(1.0, float(counts.mean()))
        usual = mean + 6 * mean**0.5  # what chance alone puts on a counter
        commonness = np.where(counts <= usual, 0, np.ceil(np.log2(np.maximum(counts, 1)))).astype(np.int8)
        with Scratch(spark) as early:  # what is wide goes once the classes stand
            sets = early.keep(_sets(df, id_col, text_col, words, num, den, commonness), "sets")
            classes = scratch.keep(sets.filter("n > 0 and id is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("rare").alias("rare"), F.first("bits").alias("bits"), F.first("brief").alias("brief")), "classes")
            members = scratch.keep(sets.select("id", "n", "sig"), "members")
        along = Window.partitionBy("token").orderBy("n", "rep")
        # two linked sets share one of the rarest of either, and of the smaller one even of fewer: those postings are ``led``
        led = is_led(F.col("place"), F.col("n"), num, den)
        lists = classes.select(F.posexplode("rare").alias("place", "token"), "rep", "n").select("token", "rep", "n", led.alias("led"))
        # a posting matters if a led one stands before it, or if it is led and another one follows
        sooner = F.coalesce(F.max("led").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
        lists = lists.withColumn("before", F.lag(F.struct("n", "rep", "led")).over(along)).withColumn("more", F.lead("rep").over(along).isNotNull() & F.col("led")).withColumn("sooner", sooner).filter("sooner or more")
        gap = F.col("before").isNull() | (F.col("before.n") * den < F.col("n") * num)
        lists = lists.withColumn("hub", F.last(F.when(gap & F.col("led"), F.col("rep")), ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0)))
        lists = scratch.keep(lists.select("token", "rep", "n", "led", "hub", F.when(~gap & F.col("before.led"), F.col("before.rep")).alias("before")), "lists")
        least, most = F.least("rep", "other").alias("a"), F.greatest("rep", "other").alias("b")
        ties = lists.select("rep", F.explode(F.array_distinct(F.array("hub", "before"))).alias("other")).filter("other is not null and other <> rep").select(least, most).distinct()
        ties = scratch.keep(_tested(ties, classes, num, den), "ties")
        near = connected_components(ties, "a", "b", scratch=scratch).toDF("rep", "unit")
        # lists on which more than one component is left
        placed = lists.select("token", "rep", "n", "led").join(near, "rep", "left").select("token", F.coalesce("unit", "rep").alias("unit"), "rep", "n", "led")
        mixed = placed.groupBy("token").agg(F.min("unit").alias("x"), F.max("unit").alias("y")).filter("x <> y").select("token")
        parts = max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
        rest = placed.join(mixed, "token", "left_semi").join(classes.select("rep", "brief"), "rep").select("token", "unit", "rep", "n", "led", "brief")
        rest = rest.repartition(parts, "token").sortWithinPartitions("token", "n", "rep").mapInArrow(lambda it: _apart(it, num, den), "a long, b long").distinct()
        # ties between units: what they join is few beside what the units hold; a unit of one class is named by it
        joined = connected_components(rest, "a", "b", scratch=scratch)
        moved = near.join(joined, near.unit == joined.node, "left").select("rep", F.coalesce("component", "unit").alias("unit"))
        alone = joined.join(near.select("rep"), joined.node == F.col("rep"), "left_anti").select(F.col("node").alias("rep"), F.col("component").alias("unit"))
        near = scratch.keep(moved.unionByName(alone), "near")
        sized = near.join(classes.select("rep", "n"), "rep")
        sums = sized.groupBy("unit").agg(F.sum("n").alias("total"))
        # blocks: members in order of size, cut every block_shingles; only neighbourhoods over that are dealt out
        big = sums.filter(F.col("total") > block_shingles)
        small = sized.join(sums.filter(F.col("total") <= block_shingles), "unit").select("rep", "unit", F.lit("").alias("pair"), F.lit(0).alias("side"))
        dealt = _dealt(sized.join(big.select("unit"), "unit"), block_shingles, num, den)
        units = scratch.keep(small.unionByName(dealt), "units")
        texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).filter("id is not null")
        # one row for each id, as repeated rows of one id may differ
        work = units.join(texts, units.rep == texts.id).select("unit", "pair", "side", "id", "text")
        found = work.repartition(parts, "unit", "pair").sortWithinPartitions("unit", "pair").mapInPandas(lambda it: _search(it, words, num, den), "src long, dst long")
        links = scratch.keep(found, "links")
        final = connected_components(links, scratch=scratch).toDF("rep", "component")
        answered = members.join(classes.select("sig", "rep").join(final, "rep", "left").select("sig", F.coalesce("component", "rep").alias("component")), "sig", "left")
        return scratch.result(answered.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")), "jaccard")


def _dealt(sized: DataFrame, block_shingles: int, num: int, den: int) -> DataFrame:
    """Members of large neighbourhoods, once for each pair of blocks in which they are to be searched.

    The running total of sizes is taken over coarse size classes first, so no single task sorts a
    whole neighbourhood: a class (sizes within a few percent) is salted into enough parts.
    """
    # size classes of about 5 %, each split by a hash of the id into parts of about half a block
    cls = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.05))).cast("long")
    classed = sized.withColumn("cls", cls)
    weight = classed.groupBy("unit", "cls").agg(F.sum("n").alias("w"), F.min("n").alias("least"), F.max("n").alias("most"))
    weight = weight.withColumn("parts", F.ceil(F.col("w") / (block_shingles / 2)).cast("long"))
    blocks = weight.select("unit", "cls", "least", "most", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    a, b = blocks.alias("a"), blocks.alias("b")
    # pairs of blocks (not of documents) whose sizes can match
    pairs = a.join(b, "unit").filter("(a.cls < b.cls or (a.cls = b.cls and a.part <= b.part))").filter(F.col("b.least") * num <= F.col("a.most") * den)
    key = F.concat_ws("-", "a.cls", "a.part", "b.cls", "b.part")
    sides = pairs.select("unit", key.alias("pair"), F.explode(F.array_distinct(F.array(F.struct(F.col("a.cls").alias("cls"), F.col("a.part").alias("part")), F.struct(F.col("b.cls").alias("cls"), F.col("b.part").alias("part"))))).alias("s")).select("unit", "pair", F.col("s.cls").alias("cls"), F.col("s.part").alias("part"))
    placed = classed.join(weight.select("unit", "cls", "parts"), ["unit", "cls"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")))
    return placed.join(sides, ["unit", "cls", "part"]).select("rep", "unit", "pair", F.lit(0).alias("side"))


def near_duplicates_removed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with exactly one row of each group of near copies. Rows without words stay.

    Rows are told apart by a key over all their columns, so ids may be null or repeated. Of a group the row with the
    smallest id is kept, null being the largest; ties go by key. Of rows that are equal in all columns one is kept.
    """
    keyed = df.withColumn("__row", row_key(*[c for c, kind in df.dtypes if "map<" not in kind]))
    with Scratch(df.sparkSession) as scratch:
        groups = jaccard_components(keyed.select("__row", text_col), "__row", text_col).filter("n_shingles > 0")
        groups = groups.groupBy(F.col("doc_id").alias("__row")).agg(F.first("component_id").alias("unit"), F.count("*").alias("copies"))
        ids = keyed.select("__row", F.struct(F.col(id_col).isNull(), F.col(id_col), "__row").alias("order")).distinct()
        placed = scratch.keep(groups.join(ids, "__row"), "placed")
        first = placed.groupBy("unit").agg(F.min("order").alias("order")).select("unit", F.col("order.__row").alias("chosen"))
        judged = placed.join(first, "unit").select("__row", (F.col("__row") == F.col("chosen")).alias("kept"), "copies")
        # what goes as a whole, and, seldom, rows of which one of several equal ones stays
        apart = scratch.result(judged.filter("not kept or copies > 1"), "apart")
    rest = without_rows(keyed, apart.select("__row"), "__row")
    if not apart.filter("kept").isEmpty():
        rest = rest.unionByName(keyed.join(apart.filter("kept").select("__row"), "__row", "left_semi").dropDuplicates(["__row"]))
    return rest.select(*df.columns)
