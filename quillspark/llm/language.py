"""Language ID with word-first backoff.

A known word scores by its log frequency in each language. A word that no language knows
backs off to its character n-grams, the longest order first, down to single characters.
The model is fitted on a bounded sample of labelled rows (``per_language`` rows expected of each
language, chosen by a hash of the id), and keeps at most ``vocabulary`` words a language and
``grams`` n-grams an order; so what is broadcast has a fixed bound. Prediction reads whole texts.

Null texts and texts without letters (characters of category L) are ``und`` with score 0. Ties go to the language
that sorts first. Without any labelled text every text is ``und``. Rows are treated one by one: a repeated row gets
the same answer twice, and a null id is never held out. Columns other than id, text and lang are not read.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_batches, mapped, pieces, texts_of



def _other_numbers() -> str:
    """The characters that count as word characters but are numbers (categories Nl and No), as ranges of a class."""
    found = [c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Nl", "No")]
    ends = [c for c, after in zip(found, [*found[1:], -1], strict=True) if after != c + 1]
    begins = [c for c, before in zip(found, [-1, *found], strict=False) if before != c - 1]
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in zip(begins, ends, strict=True))


#: Runs of letters, which are the characters of category L: what Spark's ``\p{L}`` is, too.
WORD = re.compile(rf"[^\W\d_{_other_numbers()}]+")
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray  # one row of log frequencies for each known word
    grams: list[dict[str, int]]  # longest order first
    gram_scores: list[np.ndarray]
    floor: np.ndarray  # for words of which not even a character is known


def _log_frequencies(counts: dict[str, np.ndarray], totals: np.ndarray, smooth: float) -> tuple[dict[str, int], np.ndarray]:
    index = {w: i for i, w in enumerate(counts)}
    table = np.array([*counts.values()], dtype=np.float64).reshape(len(index), len(totals))
    return index, np.log((table + smooth) / (totals + smooth * max(1, len(index)))).astype(np.float32)


def fit(labelled: DataFrame, per_language: int = 1500, vocabulary: int = 20_000, grams: int = 50_000, orders: tuple[int, ...] = (4, 3, 2, 1), smooth: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fits the model on rows with non-null text and language."""
    rows = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    # a hash of the id below the share that gives per_language rows; the same rows at every run
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(per_language / n)).otherwise(share)
    chosen = rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30))
    words = chosen.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).filter("w <> ''").groupBy("lang", "w").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "w"))
    top = words.withColumn("r", rank).filter(F.col("r") <= vocabulary).select("lang", "w", "n").collect()
    languages = sorted(sizes)
    place = {x: i for i, x in enumerate(languages)}
    counts: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(len(languages)))
    by_order = {k: defaultdict(lambda: np.zeros(len(languages))) for k in orders}
    for lang, w, n in top:
        counts[w][place[lang]] += n
    for w, c in counts.items():
        marked = f"^{w}$"
        for k in orders:
            for g in {marked[i : i + k] for i in range(len(marked) - k + 1)}:
                by_order[k][g] += c
    known = {w: c for w, c in sorted(counts.items()) if c.sum() > 1}
    index, scores = _log_frequencies(known, sum(counts.values(), np.zeros(len(languages))), smooth)
    gram_index, gram_scores = [], []
    for k in orders:
        kept = dict(sorted(by_order[k].items(), key=lambda x: (-x[1].sum(), x[0]))[:grams])
        i, s = _log_frequencies(kept, sum(by_order[k].values(), np.zeros(len(languages))), smooth)
        gram_index.append(i)
        gram_scores.append(s)
    return Model(languages, index, scores, gram_index, gram_scores, np.zeros(len(languages), np.float32))


class Scorer:
    """Scores texts by a model; remembers the scores of unseen words, in bounded number."""

    def __init__(self, model: Model, orders: tuple[int, ...] = (4, 3, 2, 1), remember: int = 100_000):
        self.m, self.orders, self.remember = model, orders, remember
        self.reset()

    def reset(self) -> None:
        self.known = dict(self.m.words)
        base = len(self.m.words)
        self.scores = np.concatenate([self.m.word_scores, np.zeros((self.remember, len(self.m.languages)), np.float32)])
        self.next, self.end = base, base + self.remember

    def unseen(self, word: str) -> np.ndarray:
        marked = f"^{word}$"
        for k, index, scores in zip(self.orders, self.m.grams, self.m.gram_scores, strict=True):
            rows = [i for j in range(len(marked) - k + 1) if (i := index.get(marked[j : j + k])) is not None]
            if rows:
                return scores[rows].mean(axis=0)
        return self.m.floor

    def predict(self, text: str) -> tuple[str, float]:
        words = Counter(WORD.findall(text.lower()))
        if not words or not self.m.languages:
            return UNKNOWN, 0.0
        total, get, room = np.zeros(len(self.m.languages)), self.known.get, max(1, self.remember)
        items = list(words.items())
        for at in range(0, len(items), room):  # a text with very many words is scored in parts
            part = items[at : at + room]
            rows = [get(w, -1) for w, _ in part]
            new = [i for i, r in enumerate(rows) if r < 0]
            if self.next + len(new) > self.end:
                self.reset()
                get = self.known.get
                rows = [get(w, -1) for w, _ in part]
                new = [i for i, r in enumerate(rows) if r < 0]
            for i in new:
                self.scores[self.next] = self.unseen(part[i][0])
                self.known[part[i][0]] = rows[i] = self.next
                self.next += 1
            total += np.array([c for _, c in part], np.float64) @ self.scores[rows]
        best = int(total.argmax())
        return self.m.languages[best], float(1.0 / np.exp(total - total[best]).sum())


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; the score is the posterior under equal priors."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    state: dict = {}

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if "scorer" not in state:
            state["scorer"] = Scorer(shared.value)
        said = [state["scorer"].predict(t) for t in texts_of(part)]
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array([a for a, _ in said], pa.string()), pa.array([b for _, b in said], pa.float64())], ["id", "lang_pred", "score"])

    return mapped(df, run, f"id {df.schema[id_col].dataType.simpleString()}, lang_pred string, score double", id_col, text_col)


def is_held_out(id_col: Column) -> Column:
    """The fold that no training reads: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(id_col.cast("string").cast("binary")) % 3 == 1


def language_predictions(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, trained outside the held-out fold."""
    model = fit(documents.filter(~is_held_out(F.col("doc_id"))))
    return predict(documents, model).select(F.col("id").alias("doc_id"), F.coalesce(is_held_out(F.col("id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def with_language(documents: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose language is recognised, with all their columns; ``und`` and scores under ``least`` go.

    Texts and columns pass through one narrow map, so nothing is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(shared.value)
        for part in (part for batch in batches for part in pieces(batch)):
            said = [scorer.predict(t) for t in texts_of(part)]
            yield part.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in said], pa.bool_()))

    bounded_batches(documents.sparkSession)
    return documents.mapInArrow(run, T.StructType(documents.schema.fields))
