"""Periodic runs: stretches of words that repeat themselves one after the other, found by a suffix automaton.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least
``min_length`` and ``exponent`` * q that no neighbouring word extends keeping period q.

1. Words become numbers. Stretches that can hold no run are left out: every gram of ``gram_words`` words that begins inside a run stands
   once more in that run, q words before or after, so grams that have no equal one within a third of their stretch cut the text.
2. Each stretch left gets a suffix automaton. Its states are visited from the longest to the shortest; each
   has the ordered set of the places where its strings end, made by merging the smaller sets of the states that link to it into the largest.
   Neighbours that a merge makes, at a distance d that the state's longest string reaches, are a square of root d.
3. Each square is extended to the left and to the right; the same stretch with several roots keeps the smallest, its period. States
   whose strings are too short for a run of ``min_length`` words need no set.

Every document is searched by itself, as a whole, in one task, with memory that follows its own words: 60 bytes or so for each word of
its longest stretch. Null and empty texts have no words and no runs; ids may be null or repeated, rows are never joined; other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, bytes_of, pieces

#: Places in a block of an ordered set.
BLOCK = 512
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class EndSet:
    """Places in order, in blocks of bounded size, so that an insertion costs about the same in a set of any size."""

    __slots__ = ("blocks", "tops", "size")

    def __init__(self, place: int):
        self.blocks, self.tops, self.size = [[place]], [place], 1

    def __iter__(self) -> Iterator[int]:
        for block in self.blocks:
            yield from block

    def add(self, x: int) -> tuple[int, int]:
        """Puts ``x`` in; the neighbours that it now has, -1 where there is none."""
        blocks, tops = self.blocks, self.tops
        k = bisect_left(tops, x)
        if k == len(tops):
            k -= 1
        block = blocks[k]
        i = bisect_left(block, x)
        before = block[i - 1] if i else blocks[k - 1][-1] if k else -1
        after = block[i] if i < len(block) else blocks[k + 1][0] if k + 1 < len(blocks) else -1
        block.insert(i, x)
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            blocks[k : k + 1] = [block[:half], block[half:]]
            tops[k : k + 1] = [block[half - 1], block[-1]]
        else:
            tops[k] = block[-1]
        return before, after


def suffix_automaton(words: list[int]) -> tuple[array, array, array]:
    """(longest string, link, place) of each state; the place is where the prefix that made the state ends, -1 for the root and for clones.

    Most states have one word to go on with, which is held in two arrays; further ones are in a dictionary.
    """
    longest, link, place, word, to = (array("i", [x]) for x in (0, -1, -1, -1, -1))
    more: dict[int, dict[int, int]] = {}

    def state(length: int, at: int) -> int:
        longest.append(length)
        link.append(0)
        place.append(at)
        word.append(-1)
        to.append(-1)
        return len(longest) - 1

    last = 0
    for at, c in enumerate(words):
        now = state(longest[last] + 1, at)
        p, q = last, -1
        while p >= 0:
            w = word[p]
            if w < 0:
                word[p], to[p] = c, now
            elif w == c:
                q = to[p]
                break
            else:
                rest = more.get(p)
                if rest is None:
                    more[p] = {c: now}
                elif c in rest:
                    q = rest[c]
                    break
                else:
                    rest[c] = now
            p = link[p]
        last = now
        if q < 0:
            continue
        if longest[p] + 1 == longest[q]:
            link[now] = q
            continue
        clone = state(longest[p] + 1, -1)
        word[clone], to[clone], link[clone] = word[q], to[q], link[q]
        if q in more:
            more[clone] = dict(more[q])
        link[q] = link[now] = clone
        while p >= 0:
            if word[p] == c:
                if to[p] != q:
                    break
                to[p] = clone
            else:
                rest = more.get(p)
                if rest is None or rest.get(c) != q:
                    break
                rest[c] = clone
            p = link[p]
    return longest, link, place


def squares(words: list[int], min_length: int, exponent: int) -> dict[int, list[int]]:
    """By distance d, places where a string with period d ends that is long enough to lie in a run: the state's own length and d together."""
    longest, link, place = suffix_automaton(words)
    least = -(-min_length * (exponent - 1) // exponent)
    ends: dict[int, EndSet] = {}
    found: dict[int, list[int]] = {}
    for v in np.argsort(-np.frombuffer(longest, np.int32), kind="stable").tolist():
        size = longest[v]
        if size < least:
            break
        mine = ends.pop(v, None)
        if place[v] >= 0:
            # a prefix's own end comes last, after the sets of all longer strings
            if mine is None:
                mine = EndSet(place[v])
            else:
                _meet(mine, (place[v],), size, min_length, exponent, found)
        up = link[v]
        if mine is None or longest[up] < least:
            continue
        held = ends.get(up)
        if held is None:
            ends[up] = mine
            continue
        if held.size < mine.size:
            held, mine = mine, held
            ends[up] = held
        _meet(held, mine, longest[up], min_length, exponent, found)
    return found


def _meet(held: EndSet, fresh, size: int, min_length: int, exponent: int, found: dict[int, list[int]]) -> None:
    """Moves places into a set; neighbours at a distance that seeds a run are noted."""
    for x in fresh:
        before, after = held.add(x)
        d = x - before
        if before >= 0 and size >= (exponent - 1) * d and size + d >= min_length:
            found.setdefault(d, []).append(x)
        d = after - x
        if after >= 0 and size >= (exponent - 1) * d and size + d >= min_length:
            found.setdefault(d, []).append(after)


def runs_in(words: list[int], min_length: int = 24, exponent: int = 3) -> list[tuple[int, int, int]]:
    """All runs as (start, length, period), in order."""
    best: dict[tuple[int, int], int] = {}
    n = len(words)
    for d, places in squares(words, min_length, exponent).items():
        end = -1
        for at in sorted(places):
            if at <= end:  # inside the run that was extended last
                continue
            start, end = at - d, at
            while start and words[start - 1] == words[start - 1 + d]:
                start -= 1
            while end + 1 < n and words[end + 1] == words[end + 1 - d]:
                end += 1
            length = end + 1 - start
            if length >= max(min_length, exponent * d) and d < best.get((start, length), n):
                best[start, length] = d
    return sorted((start, length, d) for (start, length), d in best.items())


def gram_words(min_length: int, exponent: int) -> int:
    """The longest gram of which each one that begins in a run has an equal one in that run, a period away."""
    return 1 + min_length * (exponent - 2) // exponent


def stretches(words: np.ndarray, owner: np.ndarray, min_length: int = 24, exponent: int = 3) -> list[tuple[int, int]]:
    """[begin, end) of the stretches that may hold a run; ``owner`` is the number of each word's text."""
    gram = gram_words(min_length, exponent)
    n = len(words) - gram + 1
    if n <= 0:
        return []
    key = _mix((words.astype(np.uint64) + np.uint64(1)) * _MULT)
    total = np.zeros(n, np.uint64)
    for k in range(gram):
        total = total * np.uint64(0xD6E8FEB86659FD93) + key[k : k + n]
    total = _mix(total + owner[:n].astype(np.uint64) * _MULT)
    whole = owner[:n] == owner[gram - 1 :]
    order = np.argsort(total, kind="stable")
    by_key = total[order]
    same = np.flatnonzero(by_key[1:] == by_key[:-1])
    near = np.full(n, np.iinfo(np.int64).max)
    left, right = order[same], order[same + 1]
    near[right] = right - left
    near[left] = np.minimum(near[left], right - left)
    out = [(0, n)]
    good = whole & (near <= len(words) // exponent)
    for _ in range(2):
        kept = []
        for a, b in out:
            edges = np.flatnonzero(np.diff(np.concatenate([[False], good[a:b], [False]]).astype(np.int8))) + a
            cut = np.flatnonzero(owner[a + 1 : b] != owner[a : b - 1]) + a + 1 if (a, b) == (0, n) else ()
            begins, ends = edges[::2], edges[1::2]
            if len(cut):  # texts whose grams stand side by side
                begins, ends = np.union1d(begins, cut[good[cut] & good[cut - 1]]), np.union1d(ends, cut[good[cut] & good[cut - 1]])
            long = ends - begins + gram - 1 >= min_length
            kept += zip(begins[long].tolist(), ends[long].tolist(), strict=True)
        out = kept
        for a, b in out:
            good[a:b] = near[a:b] <= (b - a + gram - 1) // exponent
    return [(a, b + gram - 1) for a, b in out]


def planted(doc: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the loop that the registered query asks for in a tenth of all documents."""
    n, h = len(words), 1 if doc is None else zlib.crc32(str(doc).encode())
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + (loop * (-(-(n - a) // p)))[: n - a]


def word_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, exponent: int = 3, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>> in order, collapsed (the words joined by one space, of each run
    only what its first period holds) of every row. ``rewrite`` may change the words of a text first."""
    if exponent < 2 or min_length < 2:
        raise ValueError("a run has at least two words and two periods")

    def solved(part: pa.RecordBatch) -> pa.RecordBatch:
        ids, texts = part.column("id").to_pylist(), [t.split() for t in bytes_of(part)]
        if rewrite:
            texts = [rewrite(i, words) for i, words in zip(ids, texts, strict=True)]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        flat = pa.array([w for words in texts for w in words], pa.large_binary()).dictionary_encode().indices.to_numpy()
        owner = np.repeat(np.arange(len(texts)), sizes)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for a, b in stretches(flat, owner, min_length, exponent):
            own = int(owner[a])
            found[own] += [(a - int(begins[own]) + s, n, q) for s, n, q in runs_in(flat[a:b].tolist(), min_length, exponent)]
        joined = []
        for words, runs in zip(texts, found, strict=True):
            if runs:
                kept = np.ones(len(words), bool)
                for s, n, q in runs:
                    kept[s + q : s + n] = False
                words = [words[i] for i in np.flatnonzero(kept).tolist()]  # noqa: PLW2901
            joined.append(b" ".join(words))
        kind = pa.list_(pa.struct([(x, pa.int64()) for x in ("start", "length", "period")]))
        rows = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in sorted(runs)] for runs in found]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(rows, kind), pa.array(joined, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield solved(part)

    bounded_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def run_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The registered query: loops are planted, and runs and collapsed texts are told as counts and digests."""
    found = word_runs(df, id_col, text_col, rewrite=planted)
    # exact fractions are compared crosswise; runs come by start and period, so the first of equal ones stays
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.try_element_at("runs", F.lit(1)), better)
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
