"""What models answer, read with care; prompts' budgets; formats for display. Per-value helpers."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_CHARS, REASON_CHARS, DOCUMENT_CHARS, PROMPT_CHARS = 120, 200, 2000, 8000


def unfence(answer: str) -> str:
    """A whole answer inside one code fence, without the fence."""
    m = re.fullmatch(r"\s*(`{3,}|~{3,})[^\n]*\n(.*?)\n?\1\s*", answer, re.DOTALL)
    return m[2] if m else answer


def sanitize_title(answer: str, most: int = TITLE_CHARS) -> str | None:
    """A title from an answer: its first line without markup, quotes and labels, cut at a word; null without a letter or digit."""
    line = next((x.strip() for x in unfence(answer).splitlines() if x.strip()), "")
    before = None
    while before != line:
        before = line
        line = re.sub(r"^(?:#{1,6}\s+|[-*+]\s+|\d+[.)]\s+|(?:title|titel)\s*:\s*)", "", line, flags=re.IGNORECASE).strip()
        for a, b in ('""', "''", "“”", "„“", "«»", "``", "**", "__"):
            if len(line) > 1 and line[0] == a and line[-1] == b:
                line = line[1:-1].strip()
    line = re.sub(r"\s+", " ", re.sub(r"\s*/\s*", "-", line)).strip(" -")
    if len(line) > most:
        at = line.rfind(" ", 0, most + 1)
        line = line[: at if at > most // 2 else most].rstrip()
    return line if any(c.isalnum() for c in line) else None


def continuation_answer(reply: str) -> dict | None:
    """{continues, confidence, reason} from the first JSON object in a reply; null if it says neither yes nor no."""
    decoder = json.JSONDecoder()
    for at in (m.start() for m in re.finditer(r"\{", reply)):
        try:
            found, _ = decoder.raw_decode(reply, at)
        except ValueError:
            continue
        said = found.get("continues")
        if isinstance(said, str):
            said = {"yes": True, "true": True, "no": False, "false": False}.get(said.strip().lower())
        if not isinstance(said, bool):
            continue
        sure = found.get("confidence", 0)
        if isinstance(sure, str):
            m = re.fullmatch(r"\s*([\d.]+)\s*(%?)\s*", sure)
            sure = float(m[1]) / (100 if m[2] else 1) if m else 0
        sure = float(sure) if isinstance(sure, (int, float)) and not isinstance(sure, bool) else 0.0
        sure = sure / 100 if sure > 1 else sure
        reason = re.sub(r"\s+", " ", str(found.get("reason") or "")).strip()[:REASON_CHARS]
        return {"continues": said, "confidence": min(1.0, max(0.0, sure)), "reason": reason}
    return None


def excerpt_chars(documents: int) -> int:
    """Each document's even share of a prompt."""
    return min(DOCUMENT_CHARS, PROMPT_CHARS // max(1, documents))


def excerpts(text: Column, documents: int) -> Column:
    return F.substring(text, 1, excerpt_chars(documents))


def gap_text(seconds: float) -> str:
    s = abs(round(seconds))
    return f"{s} s" if s < 60 else f"{round(s / 60)} min" if s < 3600 else f"{round(s / 3600)} h"


def bytes_text(n: int) -> str:
    size, unit = float(n), "B"
    for unit in ("B", "KB", "MB", "GB", "TB"):
        if size < 1024 or unit == "TB":
            break
        size /= 1024
    return f"{size:.0f} {unit}" if unit == "B" or size >= 10 else f"{size:.1f} {unit}"


def text_head(text: Column, n: int) -> Column:
    return F.left(text, F.lit(n))


def text_tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def text_page(text: Column, offset: int, n: int = 20_000) -> Column:
    """struct<text, next>: a slice of code points and where the next one starts, null at the end."""
    return F.struct(F.substring(text, offset + 1, n).alias("text"), F.when(F.length(text) > offset + n, offset + n).alias("next"))


def stored_text(text: Column) -> Column:
    """Text as it is stored: without white space around it; empty text is null."""
    clean = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.nullif(clean, F.lit(""))
