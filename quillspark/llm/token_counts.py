"""Token counts of a piece model, with overlap resynchronisation for huge texts.

A text over ``chunk`` characters is encoded in overlapping chunks with token offsets. Two
neighbours are spliced at a boundary that both have in their overlap and that is proven
stable: two characters that no piece of the vocabulary holds side by side, so no merge can ever
span it (the pairs that do occur are read from the vocabulary). A space after another character is one, and so are most
places in writing without spaces. If the overlap holds no such common boundary, the right chunk starts further left, twice as far
each time, until one is found or the chunk before is taken in whole, which then doubles; so counts are always those of the
library, and the work follows the length of the text. The library
writes a space as U+2581, so that character is a space from the start here. A chunk whose tokens' widths do not
add up to its bytes (another normaliser, say) has no offsets to trust: its text is encoded as one.

Null and empty texts have 0 tokens. Rows are treated one by one, so repeated rows, ties and other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, texts_of

SPACE = "▁"


class _Unaligned(Exception):
    """Tokens' widths do not add up to the text."""


class PieceCounter:
    """Counts tokens as sentencepiece does, chunk by chunk for long texts."""

    def __init__(self, model: bytes, chunk: int = 8192, overlap: int = 256):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.chunk, self.overlap = chunk, overlap
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        plain = [p for i, p in enumerate(pieces) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i))]
        # no piece goes on from a character to another unless some piece has the two side by side: there every text can be cut
        self.bound = {p[i : i + 2].replace(SPACE, " ") for p in plain for i in range(len(p) - 1)}
        # UTF-8 bytes of the text that a token stands for; a byte token stands for one
        self.width = np.array([1 if self.sp.is_byte(i) else 0 if self.sp.is_control(i) else len(p.replace(SPACE, " ").encode()) for i, p in enumerate(pieces)], np.int64)
        # one space is put before a text, and white space is kept as it is; otherwise offsets would mean something else
        probe = "a  b\nc é\U0001f600 "
        self.exact = all(int(self.width[self.sp.encode(t)].sum()) == len(t.encode()) + 1 for t in (probe, probe[1:], probe[3:]))

    def ends(self, text: str) -> np.ndarray:
        """The byte offset in ``text`` where each of its tokens ends."""
        ends = np.cumsum(self.width[self.sp.encode(text)]) - 1
        if ends[-1] != len(text.encode()):
            raise _Unaligned
        return ends

    def count(self, text: str) -> int:
        if not text:
            return 0
        if len(text) <= self.chunk or not self.exact:
            return len(self.sp.encode(text))
        try:
            return self.spliced(text.replace(SPACE, " "))
        except _Unaligned:
            return len(self.sp.encode(text))

    def spliced(self, text: str) -> int:
        """The count of a text longer than ``chunk``, chunk by chunk."""
        total, start, begin = 0, 0, 0  # start: of the chunk; begin: what is counted so far ends here (characters)
        chunk = text[: self.chunk]
        ends = self.ends(chunk)
        while start + len(chunk) < len(text):
            stop, back = start + len(chunk), self.overlap
            while True:
                left = max(begin, stop - back)
                right = text[left : stop - min(back, stop - left) + self.chunk] if stop - left < self.chunk else text[left : stop + self.chunk]
                right_ends = self.ends(right)
                at = self.splice(text, start, chunk, ends, left, right, right_ends, stop)
                if at is not None or left <= begin:
                    break
                back *= 2  # widened
            if at is None:  # no stable boundary between begin and stop: the chunk doubles, so all attempts together cost a few times the text
                chunk = text[start : stop + len(chunk)]
                ends = self.ends(chunk)
                continue
            cut = len(text[start:at].encode())
            first = len(text[start:begin].encode())
            total += int(np.searchsorted(ends, cut, side="right") - (np.searchsorted(ends, first, side="right") if begin > start else 0))
            start, begin, chunk, ends = left, at, right, right_ends
        first = len(text[start:begin].encode())
        return total + len(ends) - (int(np.searchsorted(ends, first, side="right")) if begin > start else 0)

    def splice(self, text: str, start: int, chunk: str, ends: np.ndarray, left: int, right: str, right_ends: np.ndarray, stop: int) -> int | None:
        """The last stable boundary inside the overlap at which tokens of both chunks meet."""
        for at in range(stop - 1, left + 1, -1):
            if text[at - 1 : at + 1] not in self.bound:
                a, b = len(text[start:at].encode()), len(text[left:at].encode())
                if ends[min(len(ends) - 1, np.searchsorted(ends, a))] == a and right_ends[min(len(right_ends) - 1, np.searchsorted(right_ends, b))] == b:
                    return at
        return None


def count_tokens(df: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", chunk: int = 8192, overlap: int = 256) -> DataFrame:
    """(id, n_bytes, n_tokens) of every whole text; ``model`` is the content of a sentencepiece model file."""
    shared = df.sparkSession.sparkContext.broadcast((model, chunk, overlap))
    state: dict = {}

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        if "counter" not in state:
            state["counter"] = PieceCounter(*shared.value)
        texts = texts_of(part)
        counts = [state["counter"].count(t) for t in texts]
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    return mapped(df, run, f"id {df.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long", id_col, text_col)


def token_report(documents: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every document. The driver reads the model file once (half a MB) and broadcasts it."""
    from pyspark.sql import functions as F

    with open(model_path, "rb") as f:
        model = f.read()
    return count_tokens(documents, model).select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
