"""Byte-level BPE by merge replay over the distinct words of a piece of the corpus.

A task takes a piece of the corpus (some MB of texts), splits it into words by the
tokenizer's pattern, and replays the merges on its distinct words at once: an inverted index
from the merged token to the positions of the pairs that make it gives, rank by rank, all
places to merge; after a merge only the two touched neighbours get new index entries. Words are
encoded once a piece, however often they occur. A word that is itself a token is taken whole,
as the library does. No shuffle is needed, and memory follows the piece, not the corpus.

Null and empty texts have no tokens. Decoding joins the tokens' bytes. Rows are treated one by one, so repeated rows,
ties and other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, mapped, texts_of

# Letters, numbers and white space among the first 256 characters, for the fast splitter.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
_FAST = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
# Fixed value: the pattern that the fast splitter stands for; another pattern is always taken at its word.
_FAST_FOR = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_WIDE = re.compile("[^\x00-\xff]")


def read_ranks(content: bytes) -> list[bytes]:
    """Token bytes by rank, from the content of a rank file."""
    ranks = {int(b): base64.b64decode(a) for a, b in (line.split() for line in content.splitlines() if line)}
    return [ranks[i] for i in range(len(ranks))]


class Replay:
    """Encodes distinct words by replaying merges in rank order."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.rank = {t: i for i, t in enumerate(tokens)}
        # every way to make a token of two: key of the pair -> token
        made = {}
        for t, r in self.rank.items():
            for k in range(1, len(t)):
                a, b = self.rank.get(t[:k]), self.rank.get(t[k:])
                if a is not None and b is not None:
                    made[a << 32 | b] = r
        self.pairs = np.array(sorted(made), np.int64)
        self.makes = np.array([made[k] for k in sorted(made)], np.int64)
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int64)
        self.splitters: dict = {}
        self.memory: dict[str, list[int]] = {}

    def split(self, text: str) -> list[str]:
        if self.pattern == _FAST_FOR and not _WIDE.search(text):
            return _FAST.findall(text)
        if "p" not in self.splitters:
            import regex

            self.splitters["p"] = regex.compile(self.pattern)
        return self.splitters["p"].findall(text)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token that each pair makes, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.makes[at], -1)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        whole = [self.rank.get(w) for w in words]
        rest = [w for w, r in zip(words, whole, strict=True) if r is None]
        ids = itertools.chain.from_iterable(self.replay(rest[k : k + REPLAY_WORDS]) for k in range(0, len(rest), REPLAY_WORDS))
        return [[r] if r is not None else next(ids) for r in whole]

    def replay(self, words: list[bytes]) -> list[list[int]]:
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        n = len(data)
        token = self.byte[data]
        word_start = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        last = word_start + sizes - 1
        after[last], before[word_start] = n, -1  # n: no neighbour
        token = np.append(token, -1)
        # the inverted index: merged token -> arrays of positions of the left half
        index: dict[int, list[np.ndarray]] = defaultdict(list)
        heap: list[int] = []

        def enter(at: np.ndarray) -> None:
            """Index entries for the pairs that begin at the positions."""
            at = at[after[at] < n]
            if not len(at):
                return
            r = self.merged(token[at], token[after[at]])
            at, r = at[r >= 0], r[r >= 0]
            if not len(at):
                return
            order = np.argsort(r, kind="stable")
            at, r = at[order], r[order]
            cuts = np.flatnonzero(np.diff(r)) + 1
            for part, k in zip(np.split(at, cuts), r[np.concatenate([[0], cuts])].tolist(), strict=True):
                if k not in index:
                    heapq.heappush(heap, k)
                index[k].append(part)

        enter(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            parts = index.pop(r)
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = at[token[at] >= 0]
            right = after[at]
            at, right = at[right < n], right[right < n]
            ok = self.merged(token[at], token[right]) == r
            at, right = at[ok], right[ok]
            if len(at) > 1:  # in a run such as aaa the left pair goes first
                clash = np.flatnonzero(right[:-1] == at[1:])
                if len(clash):
                    drop, gone = np.zeros(len(at), bool), -2
                    for c in clash.tolist():
                        if gone != c:
                            drop[c + 1] = True
                            gone = c + 1
                    at, right = at[~drop], right[~drop]
            if not len(at):
                continue
            far = after[right]
            token[at], token[right] = r, -1
            after[at] = far
            has = far < n
            before[far[has]] = at[has]
            left = before[at]
            touched = np.concatenate([left[left >= 0], at])
            enter(np.unique(touched))
        kept = np.flatnonzero(token[:n] >= 0)
        per_word = np.diff(np.searchsorted(kept, np.append(word_start, n)))
        flat, out, i = token[kept].tolist(), [], 0
        for k in per_word.tolist():
            out.append(flat[i : i + k])
            i += k
        return out

    def encode_texts(self, texts: list[str]) -> tuple[list[np.ndarray], list[str], list[list[int]]]:
        """(numbers of each text's words, the distinct words, their ids) of one piece of the corpus; no text's words are held longer than it takes to number them."""
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        texts = [np.fromiter(map(number.__getitem__, self.split(t)), np.int32) for t in texts]
        words, memory = list(number), self.memory
        ids = [memory.get(w) for w in words]
        new = [i for i, known in enumerate(ids) if known is None]
        for i, found in zip(new, self.encode([words[i].encode() for i in new]), strict=True):
            ids[i] = found
        if len(memory) + len(new) > REMEMBER:
            memory.clear()
        memory.update((words[i], ids[i]) for i in new[:REMEMBER] if len(words[i]) < 40)
        return texts, words, ids


#: Words of earlier pieces whose ids a worker keeps, words that are replayed at once, and bytes of text in a piece.
REMEMBER, REPLAY_WORDS, PIECE_BYTES = 100_000, 100_000, 4 << 20

_LOADED: dict[bytes, Replay] = {}


def loaded(content: bytes, pattern: str) -> Replay:
    """One replay table a worker and rank file."""
    key = hashlib.sha256(content + pattern.encode()).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Replay(read_ranks(content), pattern)
    return _LOADED[key]


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, content: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every whole text; ``content`` is that of a rank file, broadcast once (under 1 MB)."""
    shared = df.sparkSession.sparkContext.broadcast((content, pattern))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        texts, _, known = loaded(*shared.value).encode_texts(texts_of(part))
        ids = [[i for w in words.tolist() for i in known[w]] for words in texts]
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return mapped(df, run, f"id {df.schema[id_col].dataType.simpleString()}, ids array<int>", id_col, text_col, PIECE_BYTES)


def decode(df: DataFrame, content: bytes, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, bytes binary) from token ids; null ids give empty bytes, an id outside the vocabulary is an error."""
    from pyspark.sql import functions as F

    shared = df.sparkSession.sparkContext.broadcast(content)
    state: dict = {}

    def run(batches):
        for batch in batches:
            if "tokens" not in state:
                state["tokens"] = read_ranks(shared.value)
            tokens = state["tokens"]
            data = [b"".join([tokens[i] for i in ids or []]) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(data, pa.binary())], ["id", "bytes"])

    bounded_batches(df.sparkSession)
    return df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, bytes binary")


def bpe_digests(documents: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: texts are encoded, the ids decoded, in one pass."""
    shared = documents.sparkSession.sparkContext.broadcast((read_file(rank_path), pattern))

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        replay = loaded(*shared.value)
        texts, _, known = replay.encode_texts(texts_of(part))
        tokens = replay.tokens
        shown = [",".join(map(str, ids)).encode() for ids in known]
        decoded = [b"".join([tokens[i] for i in ids]) for ids in known]
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        counts, ids_sha, text_sha = [], [], []
        for words in texts:
            counts.append(int(sizes[words].sum()))
            places = words.tolist()
            ids_sha.append(hashlib.sha256(b",".join(map(shown.__getitem__, places))).hexdigest())
            text_sha.append(hashlib.sha256(b"".join(map(decoded.__getitem__, places))).hexdigest())
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return mapped(documents, run, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", limit=PIECE_BYTES)
