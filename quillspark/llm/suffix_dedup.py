"""Exact removal of repeated passages, by merging the Burrows-Wheeler transforms of shards.

A byte goes if a string of ``length`` bytes covers it that also starts in a document with a smaller id.

1. Exact copies of a whole text are settled by digest: only the row with the smallest id of each goes further.
2. Any two equal strings of ``length`` bytes choose the same gram inside them (the one with the least hash
   among its ``length - GRAM + 1`` grams), so equal strings meet under that gram. A piece of the corpus sends each of
   its grams once, 6 bytes for about every fourteenth byte of text, no text; grams that only one text has are
   dropped. Grams that more than ``hot_over`` pieces hold are listed, the ``HOT_LIST`` most frequent at most.
3. The passages around the remaining grams (the strings that chose them, in one piece) go to their gram's bucket,
   equal passages of a piece once, with the places where they stand.
4. In a task, the different passages of grams that have more than one form shards. Each shard's
   Burrows-Wheeler transform is built; all are merged by iterative interleave refinement: round h turns the
   interleaving by the first h - 1 symbols into that by h symbols, by one stable distribution of the
   transforms' symbols; no suffix is sorted again. The round in which a boundary between neighbours appears is
   their common prefix plus one. After ``length`` rounds the runs without a boundary are the repeated intervals; each
   takes its smallest id. A gram with one passage is a repeated interval as it stands.
5. The same task tells every place of a passage which of its starts to remove; a text's ranges are joined.
6. Grams on the list of hot ones are in no bucket: their strings are aggregated one by one to their smallest id
   before they are shuffled, so a line of a third of all texts meets in no single task.

Texts are UTF-8; null and empty texts have nothing to remove. Rows with a null id keep all their bytes and remove
none. Ranges belong to a row's text, not to its id alone: rows that share an id but not the text are treated each by
its own bytes, and none removes from another; equal rows have equal results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .common import bounded_batches, bytes_of, pieces

GRAM = 24
#: Bytes of text in a piece, and grams that are listed as hot at most.
PIECE_BYTES, HOT_LIST = 6 << 20, 1_000_000
#: Starts of strings in one merge, and bytes in a shard.
MERGE_STARTS, SHARD_BYTES = 200_000, 1 << 18
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _MULT)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """The hash of the GRAM bytes from each position on (short by GRAM - 1)."""
    p = 0xD6E8FEB86659FD93
    power = lambda k: np.uint64(pow(p, k, 1 << 64))
    one = _BYTE[data]
    two = one[:-1] * power(1) + one[1:]
    four = two[:-2] * power(2) + two[2:]
    eight = four[:-4] * power(4) + four[4:]
    sixteen = eight[:-8] * power(8) + eight[8:]
    return _mix(sixteen[: len(data) - GRAM + 1] * power(8) + eight[16 : len(data) - GRAM + 17])


def chosen_grams(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place of the gram, its hash, first start that chose it) in order; the last start that chose it is
    before the next gram's first start, or the text's last."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none
    grams = gram_hashes(data)
    width = length - GRAM + 1
    # least hash in each window, leftmost on ties: the place is in the low bits
    low = np.uint64((1 << 28) - 1)
    least = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    span = 1
    while span * 2 <= width:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    least = np.minimum(least[: len(data) - length + 1], least[width - span : width - span + len(data) - length + 1])
    ends = np.cumsum(sizes)
    starts = np.concatenate([np.arange(b, e - length + 1) for b, e in zip(ends - sizes, ends, strict=True) if e - b >= length] or [none])
    if not len(starts):
        return none, none, none.astype(np.uint64), none
    place = (least[starts] & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    place, begin = place[first], starts[first]
    owner = np.searchsorted(ends, begin, side="right")
    base = (ends - sizes)[owner]
    return owner, place - base, grams[place], begin - base


def suffix_order(data: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of a shard in order of their first ``depth`` symbols at least; 0 ends each string."""
    n = len(data)
    left = ends[np.searchsorted(ends, np.arange(n), side="left")] - np.arange(n)  # symbols up to the string's end
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for k in range(8):
        key = (key << np.uint64(8)) | np.where(left >= k, padded[k : k + n], 0).astype(np.uint64)
    order = np.argsort(key)
    rank = np.empty(n, np.uint64)
    rank[order] = np.cumsum(np.concatenate([[True], key[order][1:] != key[order][:-1]])).astype(np.uint64)
    span = 8
    while span < depth:
        ahead = np.zeros(n, np.uint64)
        inside = np.flatnonzero(left >= span)
        ahead[inside] = rank[inside + span]
        key = (rank << np.uint64(32)) | ahead
        order = np.argsort(key)
        rank[order] = np.cumsum(np.concatenate([[True], key[order][1:] != key[order][:-1]])).astype(np.uint64)
        span *= 2
    return order


class Shard:
    """The transform of some strings: ``symbols[i]`` stands before the i-th suffix in order; bytes count one up, 0 ends a string."""

    def __init__(self, strings: list[bytes], depth: int):
        # the end mark sorts before all bytes; UTF-8 has no byte 255, so one up fits
        joined = b"\xff".join(strings) + b"\xff"
        data = (np.frombuffer(joined, np.uint8).astype(np.uint16) + 1).astype(np.uint8)  # 255 becomes 0
        self.strings, ends = len(strings), np.flatnonzero(data == 0)
        order = suffix_order(data, ends, depth)
        # end marks differ from each other: they stand in the order of their strings
        marks = order[: len(ends)]
        order[: len(ends)] = np.sort(marks)
        self.symbols = data[order - 1]
        self.symbols[order == 0] = 0
        self.suffix = order
        self.owner = np.searchsorted(ends, order, side="left")
        begins = np.concatenate([[0], ends[:-1] + 1])
        self.offset = order - begins[self.owner]


def _places(z: np.ndarray, shards: int) -> np.ndarray:
    """The places of the first shard in an interleaving, then those of the second, and so on."""
    if shards <= 8:
        return np.concatenate([np.flatnonzero(z == k) for k in range(shards)])
    return np.argsort(z, kind="stable")


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The interleaving of the shards' suffixes by ``rounds`` symbols (a shard number for each place), and the common
    prefix of each place with the one before (``rounds`` where it is that or more)."""
    sizes = [len(s.symbols) for s in shards]
    n = sum(sizes)
    small = np.uint8 if len(shards) < 256 else np.uint16
    z = np.repeat(np.arange(len(shards), dtype=small), sizes)
    symbols = np.concatenate([s.symbols for s in shards])
    strings = sum(s.strings for s in shards)
    ends_first = np.repeat(np.arange(len(shards), dtype=small), [s.strings for s in shards])
    common = np.full(n, rounds, np.int16)
    edge = np.zeros(n, bool)
    edge[0] = True
    common[0] = 0
    for h in range(1, rounds + 1):
        # the transforms' symbols in the present interleaving
        now = np.empty(n, np.uint8)
        now[_places(z, len(shards))] = symbols
        block = np.cumsum(edge, dtype=np.int32)
        order = np.argsort(now, kind="stable")
        z_next = z[order]
        z_next[:strings] = ends_first
        moved, blocks = now[order], block[order]
        edge_next = np.empty(n, bool)
        edge_next[0] = True
        edge_next[1:] = (moved[1:] != moved[:-1]) | (blocks[1:] != blocks[:-1])
        edge_next[:strings] = True
        fresh = edge_next & (common == rounds)
        fresh[0] = False
        common[fresh] = h - 1
        same = np.array_equal(z_next, z) and np.array_equal(edge_next, edge)
        z, edge = z_next, edge_next
        if same:
            break
    return z, common


def least_ids(strings: list[bytes], ids: np.ndarray, length: int, shard_bytes: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(ids, starts): for every start of ``length`` bytes in each string, one string after the other, the smallest id of a
    string that has the same bytes anywhere; and how many starts each string has."""
    shards, firsts, held, size = [], [], [], 0
    for i, s in enumerate(strings):
        if not held:
            firsts.append(i)
        held.append(s)
        size += len(s) + 1
        if size >= shard_bytes or i + 1 == len(strings):
            shards.append(Shard(held, length))
            held, size = [], 0
    starts = np.maximum(np.fromiter(map(len, strings), np.int64, len(strings)) - length + 1, 0)
    flat = np.repeat(ids, starts)
    if not shards:
        return flat, starts
    z, common = merge(shards, length)
    lead = _places(z, len(shards))
    owner, offset = np.empty(len(z), np.int64), np.empty(len(z), np.int64)
    owner[lead] = np.concatenate([s.owner + f for s, f in zip(shards, firsts, strict=True)])
    offset[lead] = np.concatenate([s.offset for s in shards])
    heads = np.flatnonzero(common < length)
    runs = np.diff(np.append(heads, len(z)))
    least = np.repeat(np.minimum.reduceat(ids[owner], heads), runs)
    shared = np.repeat(runs > 1, runs)
    take = np.flatnonzero(shared & (offset < starts[owner]))
    base = np.cumsum(starts) - starts
    flat[base[owner[take]] + offset[take]] = least[take]
    return flat, starts


def _six(hashes: np.ndarray) -> np.ndarray:
    """Hashes as rows of their six upper bytes."""
    return np.ascontiguousarray(hashes.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, 2:]


def _from_six(data: bytes) -> np.ndarray:
    """What ``_six`` packed, without the two lower bytes."""
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _bounds(sorted_keys: np.ndarray) -> np.ndarray:
    """Where equal keys begin, and the end."""
    return np.concatenate([[0], np.flatnonzero(sorted_keys[1:] != sorted_keys[:-1]) + 1, [len(sorted_keys)]])


def _postings(batches: Iterator[pa.RecordBatch], length: int, buckets: int, choose=chosen_grams) -> Iterator[pa.RecordBatch]:
    """The distinct grams that ``choose`` finds in each piece, packed by bucket: those of one text with the text's key (keys, grams for each, grams), those
    that several texts of the piece hold (``known``). The latter's texts are told at once, in rows with a bucket below 0."""
    names = ["bucket", "keys", "counts", "grams", "known"]
    for batch in batches:
        for part in pieces(batch, limit=PIECE_BYTES):
            texts, keys = bytes_of(part), part.column("t").to_numpy()
            once = sorted({x: i for i, x in enumerate(texts)}.values())
            texts, keys = [texts[i] for i in once], keys[once]
            owner, _, gram, _ = choose(texts, length)
            if not len(owner):
                continue
            order = np.lexsort((owner, gram))
            gram, owner = gram[order], owner[order]
            fresh = np.concatenate([[True], (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])])
            gram, owner = gram[fresh], owner[fresh]
            cuts = _bounds(gram)
            many = np.repeat(np.diff(cuts) > 1, np.diff(cuts))
            rows = []
            if many.any():
                told = np.argsort(owner[many], kind="stable")
                own, all_grams = owner[many][told], _six(gram[many][told])
                at = _bounds(own)
                where = -1 - int(keys[own[0]] % buckets)
                rows.append((where, keys[own[at[:-1]]].tobytes(), np.diff(at).astype(np.uint32).tobytes(), all_grams.tobytes(), b""))
            heads = cuts[:-1]
            gram, owner, many = gram[heads], np.where(many[heads], -1, owner[heads]), many[heads]
            bucket = (gram % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((owner, bucket))
            bucket, owner, packed = bucket[order], owner[order], _six(gram[order])
            at = _bounds(bucket)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                known = a + int(np.searchsorted(owner[a:b], 0))
                own = owner[known:b]
                runs = _bounds(own) if len(own) else np.zeros(1, np.int64)
                rows.append((int(bucket[a]), keys[own[runs[:-1]]].tobytes(), np.diff(runs).astype(np.uint32).tobytes(), packed[known:b].tobytes(), packed[a:known].tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket after the other; rows are sorted by bucket."""
    now, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if row["bucket"] != now and held:
                yield held
                held = []
            now = row["bucket"]
            held.append(row)
    if held:
        yield held


def _shared(batches: Iterator[pa.RecordBatch], hot_over: int) -> Iterator[pa.RecordBatch]:
    """(t, grams) of each text whose gram another text holds too, packed; and, without t, each gram of more than ``hot_over`` pieces with n, their number."""
    types = [pa.int64(), pa.binary(), pa.int64()]

    def told(keys: np.ndarray, grams: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(keys, kind="stable")
        keys, packed = keys[order], np.ascontiguousarray(grams[order].astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
        at = _bounds(keys)
        data = [packed[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(keys[at[:-1]]), pa.array(data, types[1]), pa.nulls(len(data), types[2])], ["t", "grams", "n"])

    for rows in _by_bucket(batches):
        # one row at a time where texts are told what their own piece found
        parts = [[r] for r in rows] if rows[0]["bucket"] < 0 else [rows]
        for some in parts:
            keys = np.concatenate([np.repeat(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["counts"], np.uint32)) for r in some])
            grams = _from_six(b"".join(r["grams"] for r in some))
            if some[0]["bucket"] < 0:
                yield told(keys, grams)
                continue
            known = _from_six(b"".join(r["known"] for r in some))
            every = np.sort(np.concatenate([grams, known]))
            at = _bounds(every)
            distinct, n = every[at[:-1]], np.diff(at)
            met = (n > 1) | np.isin(distinct, known)
            take = np.isin(grams, distinct[met])
            if take.any():
                yield told(keys[take], grams[take])
            hot = np.flatnonzero(n > hot_over)
            if len(hot):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(hot), types[0]), pa.array([distinct[i : i + 1].tobytes() for i in hot.tolist()], types[1]), pa.array(n[hot])], ["t", "grams", "n"])


class _Wanted:
    """The places of a piece's texts whose gram was told to be shared: owner, gram, first start and last start that chose it."""

    def __init__(self, part: pa.RecordBatch, length: int, hot: np.ndarray, take_hot: bool):
        self.texts = texts = bytes_of(part)
        owner, _, gram, begin = chosen_grams(texts, length)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        last = np.append(begin[1:], 0)[: len(begin)] - 1
        end_of = np.append(owner[1:] != owner[:-1], True)[: len(owner)]
        last[end_of] = sizes[owner[end_of]] - length
        short = gram >> np.uint64(16)
        wanted = np.zeros(len(owner), bool)
        bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
        for i, told in enumerate(part.column("grams").to_pylist()):
            a, b = bounds[i], bounds[i + 1]
            wanted[a:b] = np.isin(short[a:b], _from_six(b"".join(told)))
        wanted &= np.isin(short, hot) == take_hot
        pick = np.flatnonzero(wanted)
        self.owner, self.gram, self.begin, self.last = owner[pick], gram[pick], begin[pick], last[pick]
        self.ids, self.keys = part.column("id").to_numpy(), part.column("t").to_numpy()


def _passages(batches: Iterator[pa.RecordBatch], length: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The different passages around the shared grams of a piece, packed by bucket: gram, size and bytes of each, and its places (id, t, begin)."""
    names = ["grams", "sizes", "passages", "places", "ids", "keys", "begins"]
    for batch in batches:
        for part in pieces(batch, limit=PIECE_BYTES):
            w = _Wanted(part, length, hot, False)
            if not len(w.owner):
                continue
            texts, seen = w.texts, {}
            entry = np.fromiter(
                (seen.setdefault((g, texts[o][s : e + length]), len(seen)) for o, g, s, e in zip(w.owner.tolist(), w.gram.tolist(), w.begin.tolist(), w.last.tolist(), strict=True)), np.int64, len(w.owner)
            )
            spans = [span for _, span in seen]
            grams = np.fromiter((g for g, _ in seen), np.uint64, len(seen))
            bucket = (grams % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            at_places = np.argsort(rank[entry], kind="stable")
            places = np.bincount(rank[entry], minlength=len(order))
            ends = np.concatenate([[0], np.cumsum(places)])
            own = w.owner[at_places]
            ids, keys, begins = w.ids[own], w.keys[own], w.begin[at_places].astype(np.uint32)
            cuts, sizes = _bounds(bucket[order]), np.fromiter(map(len, spans), np.uint32, len(spans))
            rows = []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                some, x, y = order[a:b], int(ends[a]), int(ends[b])
                rows.append((int(bucket[some[0]]), grams[some].tobytes(), sizes[some].tobytes(), pa.compress(b"".join([spans[i] for i in some.tolist()]), "zstd", asbytes=True), places[a:b].astype(np.uint32).tobytes(), ids[x:y].tobytes(), keys[x:y].tobytes(), begins[x:y].tobytes()))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["bucket", *names])


def _strings(batches: Iterator[pa.RecordBatch], length: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Every string that chose a hot gram: (s, id, t, begin)."""
    for batch in batches:
        for part in pieces(batch, limit=PIECE_BYTES):
            w = _Wanted(part, length, hot, True)
            n = w.last - w.begin + 1
            starts = np.repeat(w.begin, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            own = np.repeat(w.owner, n)
            data = [w.texts[o][s : s + length] for o, s in zip(own.tolist(), starts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), pa.array(w.ids[own]), pa.array(w.keys[own]), pa.array(starts.astype(np.int32))], ["s", "id", "t", "begin"])


def _solved(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """For each text of a bucket, the ranges of starts to remove: (id, t, a, b), ``b`` past the last.

    Equal strings always share their gram, so a bucket is searched by itself.
    """
    for rows in _by_bucket(batches):
        read = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in rows])  # noqa: E731, B023
        grams, sizes, places = read("grams", np.uint64), read("sizes", np.uint32).astype(np.int64), read("places", np.uint32).astype(np.int64)
        ids, keys, begins = read("ids", np.int64), read("keys", np.int64), read("begins", np.uint32).astype(np.int64)
        held = [int(np.frombuffer(r["sizes"], np.uint32).sum()) for r in rows]
        data, at, seen, entry = b"".join(pa.decompress(r["passages"], n, "zstd", asbytes=True) for r, n in zip(rows, held, strict=True)), 0, {}, []
        for g, n in zip(grams.tolist(), sizes.tolist(), strict=True):
            entry.append(seen.setdefault((g, data[at : at + n]), len(seen)))
            at += n
        passages = [p for _, p in seen]
        of_place = np.repeat(np.array(entry, np.int64), places)  # the passage at each place
        least = np.full(len(passages), np.iinfo(np.int64).max)
        np.minimum.at(least, of_place, ids)
        gram = np.fromiter((g for g, _ in seen), np.uint64, len(seen))
        _, which, forms = np.unique(gram, return_inverse=True, return_counts=True)
        several = np.flatnonzero(forms[which] > 1)
        # runs of starts with one answer: passage, from, to, smallest id
        alone = np.ones(len(passages), bool)
        alone[several] = False
        single = np.flatnonzero(alone)
        starts = np.fromiter(map(len, passages), np.int64, len(passages)) - length + 1
        run_p, run_a, run_b, run_id = [single], [np.zeros(len(single), np.int64)], [starts[single]], [least[single]]
        if len(several):
            # whole grams at a time, so that what a merge goes through again and again stays near the processor
            groups = which[several] % max(1, -(-int(starts[several].sum()) // MERGE_STARTS))
            several = several[np.argsort(groups, kind="stable")]
            cuts = np.append(np.cumsum(np.bincount(groups)), 0)
            flat = np.concatenate([least_ids([passages[i] for i in several[a:b].tolist()], least[several[a:b]], length, SHARD_BYTES)[0] for a, b in zip(cuts[-1:].tolist() + cuts[:-2].tolist(), cuts[:-1].tolist(), strict=True)])
            owner = np.repeat(several, starts[several])
            change = np.concatenate([[True], (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])])
            first = np.flatnonzero(change)
            base = np.repeat(np.cumsum(starts[several]) - starts[several], starts[several])
            run_p.append(owner[first])
            run_a.append(first - base[first])
            run_b.append(np.append(first[1:], len(flat)) - base[first])
            run_id.append(flat[first])
        run_p, run_a, run_b, run_id = map(np.concatenate, (run_p, run_a, run_b, run_id))
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


def removed_runs(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte runs that strings starting in the ranges cover."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        end = b - 1 + length
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([a, end])
    return [(a, b) for a, b in out]


def repeated_passages(rows: DataFrame, firsts: DataFrame, scratch: Scratch, length: int = 50, hot_over: int = 20_000, parts: int | None = None) -> DataFrame:
    """(id, t, ranges array<struct<a array<int>, b array<int>>>): for each text its ranges of starts to remove.

    ``rows`` has id, text, t (the text's 64-bit key) and digest; ``firsts`` the smallest id of each text, and ``which``, its key if
    the id has other texts too, else 0: that is the t of the answer.
    """
    spark = rows.sparkSession
    parts = parts or max(spark.sparkContext.defaultParallelism * 2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = parts * 4
    with Scratch(spark) as early:
        packed = rows.select("t", "text").mapInArrow(lambda it: _postings(it, length, buckets), "bucket long, keys binary, counts binary, grams binary, known binary")
        told = early.keep(packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _shared(it, hot_over), "t long, grams binary, n long"), "told")
        listed = told.filter("t is null").orderBy(F.desc("n"), "grams").limit(HOT_LIST).select("grams").collect()
        hot = np.sort(np.frombuffer(b"".join(bytes(r["grams"]) for r in listed), "<u8")) if listed else np.zeros(0, np.uint64)
        shared = spark.sparkContext.broadcast(hot)
        spots = told.filter("t is not null").groupBy("t").agg(F.collect_list("grams").alias("grams"))
        chosen = rows.drop("t").join(firsts.join(spots, "t").select("id", "digest", F.col("which").alias("t"), "grams"), ["id", "digest"]).select("id", "t", "text", "grams")
        found = chosen.mapInArrow(lambda it: _passages(it, length, buckets, shared.value), "bucket long, grams binary, sizes binary, passages binary, places binary, ids binary, keys binary, begins binary")
        ranges = found.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda it: _solved(it, length), "id long, t long, a array<int>, b array<int>")
        if listed:
            strings = scratch.keep(chosen.mapInArrow(lambda it: _strings(it, length, shared.value), "s binary, id long, t long, begin int"), "strings")
            least = strings.groupBy("s").agg(F.min("id").alias("least"))
            gone = strings.join(least, "s").filter(F.col("least") < F.col("id"))
            ranges = ranges.unionByName(gone.groupBy("id", "t").agg(F.collect_list("begin").alias("a"), F.collect_list((F.col("begin") + 1).cast("int")).alias("b")))
        return scratch.keep(ranges.groupBy("id", "t").agg(F.collect_list(F.struct("a", "b")).alias("ranges")), "ranges")


def passage_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, hot_over: int = 20_000) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row."""
    bounded_batches(df.sparkSession)
    with Scratch(df.sparkSession) as scratch:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        every = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text")).select("id", "text", F.xxhash64("text").alias("t"), F.unhex(F.sha2("text", 256)).alias("digest"))
        rows = every.filter(F.col("id").isNotNull() & (F.octet_length("text") >= length))
        firsts = scratch.keep(rows.groupBy("digest", "t").agg(F.min("id").alias("id")), "leads")
        shared = firsts.groupBy("id").agg((F.count("*") > 1).alias("shared")).filter("shared")
        firsts = scratch.keep(firsts.join(shared, "id", "left").withColumn("which", F.when(F.col("shared"), F.col("t")).otherwise(F.lit(0).cast("long"))).drop("shared"), "firsts")
        ranges = repeated_passages(rows, firsts, scratch, length, hot_over)
        # a row is first of its text if its id is the digest's smallest; else it is a copy and goes as a whole
        answers = firsts.drop("t").withColumnRenamed("which", "t").join(ranges, ["id", "t"], "left").select("id", "digest", "ranges", F.lit(True).alias("first"))
        mine = every.join(answers, ["id", "digest"], "left").select("id", "text", "ranges", "first")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for doc, text, told, first in zip(batch.column("id").to_pylist(), bytes_of(batch), batch.column("ranges").to_pylist(), batch.column("first").to_pylist(), strict=True):
                    if doc is not None and not first:
                        runs = [(0, len(text))] if len(text) >= length else []
                    else:
                        runs = removed_runs([x for r in told or [] for x in zip(r["a"], r["b"], strict=True)], length)
                    kept, at = [], 0
                    for a, b in runs:
                        kept.append(text[at:a])
                        at = b
                    kept.append(text[at:])
                    out.append((doc, len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(b"".join(kept)).hexdigest()))
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return scratch.result(mine.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"), "dedup")
