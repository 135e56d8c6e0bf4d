"""What one scan says about the pages before and after it: one row of features a document, read once, so that pairs are compared by columns.

Per-document readers are small scanners over a text's words; everything about pairs is a column expression.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.extract import find_dates
from ..settings import LINKAGE, Linkage

DIGITS = frozenset("0123456789")

# Words that a page number follows, in full and short; words between a page and the count of pages.
PAGE_WORDS = ("page", "seite", "blatt")
PAGE_SHORT = ("p", "pg", "s")
PAGE_OF = ("of", "von", "/")
# What a reference number is labelled with, by the name of the label, and what may stand between label and number.
LABELS = {
    "invoice no.": ("invoice", "inv", "rechnungs", "rechnung", "rg"),
    "customer no.": ("customer", "client", "kunden", "kd"),
    "account no.": ("account", "acct", "konto"),
    "order no.": ("order", "bestell", "auftrags", "auftrag"),
    "contract no.": ("contract", "vertrags", "vertrag"),
    "policy no.": ("policy", "police", "versicherungsschein"),
    "reference": ("reference", "referenz", "ref", "aktenzeichen", "case"),
}
#: The labels' stems by their first letter, in the labels' order: (order, label, stems).
_STEMS = {c: [(k, label, some) for k, (label, stems) in enumerate(LABELS.items()) if (some := [x for x in stems if x[0] == c])] for c in {x[0] for stems in LABELS.values() for x in stems}}
NUMBER_WORDS = ("no", "nr", "number", "nummer", "num", "id")
# Legal forms of companies, openings of letters.
LEGAL_FORMS = ("GmbH", "mbH", "AG", "KG", "OHG", "UG", "e.V.", "e. V.", "Ltd", "Inc", "LLC", "plc", "Corp", "S.A.", "B.V.")
GREETINGS = ("dear", "sehr geehrte", "liebe", "lieber", "hallo", "hello", "to whom")
# Characters with which a line ends in the middle of a sentence, besides letters; copies are numbered from one of these.
OPEN_ENDS, FIRST_COPIES = (",", "-", "–"), (1, 2)


class Token(NamedTuple):
    """A run of letters, a run of digits, or one other character; white space only parts them."""

    text: str
    at: int
    line: int

    @property
    def end(self) -> int:
        return self.at + len(self.text)

    @property
    def is_number(self) -> bool:
        return self.text[0] in DIGITS


def tokens(text: str) -> list[Token]:
    out, i, line, n = [], 0, 0, len(text)
    while i < n:
        c, start = text[i], i
        i += 1
        if c in DIGITS:
            while i < n and text[i] in DIGITS:
                i += 1
        elif c.isalpha():
            while i < n and text[i].isalpha():
                i += 1
        elif c.isspace():
            line += c == "\n"
            continue
        out.append(Token(text[start:i], start, line))
    return out


def page_markers(text: str, most: int = LINKAGE.max_pages) -> list[tuple[int, int | None]]:
    """(page, count of pages or none) as printed, in order.

    With a count a marker counts anywhere ("Page 2 of 3", "S. 2 von 3"); without one, or as bare figures ("2/3"), only on a line of its own.
    """
    if DIGITS.isdisjoint(text):
        return []
    ts, out = tokens(text), []

    def small(k: int) -> int | None:
        return int(ts[k].text) if k < len(ts) and ts[k].is_number and len(ts[k].text) <= 3 else None

    def counted(k: int) -> tuple[int, int] | None:
        """Page and count from token ``k`` on."""
        if small(k) is not None and k + 2 < len(ts) and ts[k + 1].text.lower() in PAGE_OF and small(k + 2) is not None:
            return small(k), small(k + 2)
        return None

    def alone(first: int, last: int) -> bool:
        """Nothing but dashes stands beside these tokens on their lines."""
        before, after = first - 1, last + 1
        while before >= 0 and ts[before].line == ts[first].line and ts[before].text in "-–":
            before -= 1
        while after < len(ts) and ts[after].line == ts[last].line and ts[after].text in "-–":
            after += 1
        return (before < 0 or ts[before].line != ts[first].line) and (after == len(ts) or ts[after].line != ts[last].line)

    for k, t in enumerate(ts):
        word = t.text.lower()
        if word in PAGE_WORDS and k + 1 < len(ts) and ts[k + 1].at > t.end:
            if pair := counted(k + 1):
                out.append(pair)
            elif small(k + 1) is not None and alone(k, k + 1):
                out.append((small(k + 1), None))
        elif word in PAGE_SHORT and k + 1 < len(ts) and ts[k + 1].text == "." and ts[k + 1].at == t.end:
            if pair := counted(k + 2):
                out.append(pair)
        elif t.is_number and k + 2 < len(ts) and ts[k + 1].text == "/" and counted(k) and alone(k, k + 2):
            out.append(counted(k))
    return [(n, of) for n, of in out if n >= 1 and (of is None or n <= of <= most)]


def _is_wordy(text: str, i: int) -> bool:
    return 0 <= i < len(text) and (text[i].isalpha() or text[i] in DIGITS)


def _number_end(text: str, i: int) -> int | None:
    """Where digits with single separators between them end, if no letter follows; ``i`` is at the first digit."""
    good = None
    while True:
        while i < len(text) and text[i] in DIGITS:
            i += 1
        if not _is_wordy(text, i):
            good = i
        if i + 1 < len(text) and text[i] in "-/." and text[i + 1] in DIGITS:
            i += 1
        else:
            return good


def _number_at(text: str, i: int) -> int | None:
    """Where a number ends that begins here: up to four letters and a separator may stand before the first digit."""
    j = i
    while j < len(text) and text[j].isalpha():
        j += 1
    if j - i > 4:
        return None
    if j > i and j < len(text) and text[j] in "-/":
        j += 1
    return _number_end(text, j) if j < len(text) and text[j] in DIGITS else None


def plain_number(value: str) -> str:
    return "".join(c for c in value.upper() if c not in "-/.")


def numbers(text: str) -> list[str]:
    """All numbers as printed: the tokens among which a labelled one may be found again."""
    out, i = [], 0
    if DIGITS.isdisjoint(text):
        return out
    while i < len(text):
        if (text[i].isalpha() or text[i] in DIGITS) and not _is_wordy(text, i - 1):
            end = _number_at(text, i)
            if end is not None:
                out.append(text[i:end])
                i = end
                continue
        i += 1
    return out


def _spaces(text: str, i: int) -> int:
    while i < len(text) and text[i].isspace():
        i += 1
    return i


def _labelled_at(text: str, low: str, i: int) -> int | None:
    """Where the number begins that follows a label's stem, which ends at ``i``: a word for "number", a colon or # may stand between."""

    def value(j: int) -> int | None:
        j = _spaces(text, j)
        if j < len(text) and text[j] in ":#":
            j = _spaces(text, j + 1)
        return j if _number_at(text, j) is not None else None

    j = i
    for mark in ".-":
        if text.startswith(mark, j):
            j += 1
    j = _spaces(text, j)
    for word in NUMBER_WORDS:
        end = j + len(word)
        if low.startswith(word, j) and not (end < len(text) and text[end].isalpha()):
            found = value(end + text.startswith(".", end))
            if found is None and text.startswith(".", end):
                found = value(end)
            if found is not None:
                return found
    return value(i)


def labelled_numbers(text: str, filed, s: Linkage = LINKAGE) -> list[tuple[str, str]]:
    """(label, number as printed): long enough, and no dates."""
    if DIGITS.isdisjoint(text):
        return []
    out, low = [], text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    for t in tokens(text):
        for order, label, stems in _STEMS.get(low[t.at], ()):
            ends = (_labelled_at(text, low, t.at + len(stem)) for stem in stems if low.startswith(stem, t.at))
            at = next((x for x in ends if x is not None), None)
            if at is not None:
                value = text[at : _number_at(text, at)]
                if sum(c in DIGITS for c in value) >= s.min_digits and not find_dates(value, "DMY", filed):
                    out.append((order, label, value))
    return [(label, value) for _, label, value in sorted(out, key=lambda x: x[0])]


def name_parts(filename: str) -> tuple[str, str, float | None, bool]:
    """(name without its ending, stem, number, whether a copy counter) of a file name, in lower case.

    A number is a counter in brackets at the end, else the last run of digits, in whose place the stem has #.
    """
    name = filename.strip().lower()
    dot = name.rfind(".")
    if dot >= 0 and 1 <= len(name) - dot - 1 <= 5 and all(c in DIGITS or "a" <= c <= "z" for c in name[dot + 1 :]):
        name = name[:dot]
    if name.endswith(")"):
        at = name.rfind("(")
        inside = name[at + 1 : -1]
        if at >= 0 and inside and all(c in DIGITS for c in inside):
            return name, name[:at].rstrip(), float(inside), True
    end = len(name)
    while end and name[end - 1] not in DIGITS:
        end -= 1
    if not end:
        return name, name, None, False
    start = end
    while start and name[start - 1] in DIGITS:
        start -= 1
    return name, f"{name[:start]}#{name[end:]}", float(name[start:end]), False


def content_lines(text: str, s: Linkage = LINKAGE) -> list[str]:
    """Lines that say something: a line with a page marker is a header or footer."""
    lines = (x.strip() for x in text.replace("\r\n", "\n").split("\n"))
    return [x for x in lines if x and not page_markers(x, s.max_pages)]


def has_legal_form(line: str) -> bool:
    for form in LEGAL_FORMS:
        at = line.find(form)
        while at >= 0:
            end = at + len(form)
            if not (at and line[at - 1].isalpha()) and not (end < len(line) and line[end].isalpha()):
                return True
            at = line.find(form, at + 1)
    return False


def opening(lines: list[str], filed, s: Linkage = LINKAGE) -> str | None:
    """What a document that begins anew begins with, if its first lines show it."""
    for line in lines[: s.letterhead_lines]:
        if has_legal_form(line):
            return "letterhead"
        if line.lower().startswith(GREETINGS):
            return "greeting"
        if find_dates(line, "DMY", filed):
            return "date"
    return None


def ends_open(line: str) -> bool:
    return bool(line) and (line[-1].isalpha() or line[-1] in OPEN_ENDS)


def starts_lower(line: str) -> bool:
    first = next((c for c in line if c.isalpha() or c in DIGITS), "")
    return first.islower()


#: Characters of a text that is short enough to be remembered.
SHORT = 256
FEATURES = (
    "name string, stem string, number double, is_copy boolean, start_page int, start_of int, end_page int, end_of int, "
    "labelled array<struct<label:string,value:string,plain:string>>, numbers array<string>, ends_open boolean, starts_lower boolean, opening string"
)


def features_of(filename: str, head: str, tail: str, filed, s: Linkage = LINKAGE) -> dict:
    """The features of one document; ``filed`` is the day it was filed, which stands for today."""
    name, stem, number, is_copy = name_parts(filename)
    if len(head) + len(tail) <= SHORT and s is LINKAGE:
        return {"name": name, "stem": stem, "number": number, "is_copy": is_copy, **_short_text_features(head, tail, filed)}
    return {"name": name, "stem": stem, "number": number, "is_copy": is_copy, **_text_features(head, tail, filed, s)}


def _text_features(head: str, tail: str, filed, s: Linkage) -> dict:
    marks = [*page_markers(head, s.max_pages), *page_markers(tail, s.max_pages)]
    (start, start_of), (end, end_of) = (marks[0], marks[-1]) if marks else ((None, None), (None, None))
    whole = f"{head}\n{tail}"
    first, last = content_lines(head, s), content_lines(tail, s)
    found = [{"label": label, "value": v, "plain": plain_number(v)} for label, v in labelled_numbers(whole, filed, s)]
    long = {p for p in map(plain_number, numbers(whole)) if sum(c in DIGITS for c in p) >= s.min_digits}
    return {
        "start_page": start, "start_of": start_of, "end_page": end, "end_of": end_of, "labelled": found, "numbers": sorted(long),
        "ends_open": ends_open(last[-1]) if last else False, "starts_lower": starts_lower(first[0]) if first else False, "opening": opening(first, filed, s),
    }


@functools.lru_cache(maxsize=1 << 14)
def _short_text_features(head: str, tail: str, filed) -> dict:
    """Short texts (stamps, covers, pages without print) come again and again, so a worker remembers some of them: 16 MB or so at most."""
    return _text_features(head, tail, filed, LINKAGE)


def with_features(candidates: DataFrame, s: Linkage = LINKAGE) -> DataFrame:
    """(id, created_at, document_date, vendor, mean_embedding and ``FEATURES``) of candidates, each text read once. Write it once, compare it often.

    Null names and texts are empty; an empty table gives an empty one. Other columns are left out.
    """
    kept = ["id", "created_at", "document_date", "vendor", "mean_embedding"]
    types = dict(candidates.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept)
    read = candidates.select(*kept, F.to_date(F.col("created_at").cast("timestamp")).alias("__filed"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__{c}") for c in ("original_filename", "text_head", "text_tail")])

    def run(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [features_of(n, h, t, d, s) for n, h, t, d in zip(frame["__original_filename"], frame["__text_head"], frame["__text_tail"], frame["__filed"], strict=True)]
            made = pd.DataFrame(rows, index=frame.index, columns=[x.split()[0] for x in FEATURES.split(", ")])
            for c in ("start_page", "start_of", "end_page", "end_of"):
                made[c] = made[c].astype("Int32")
            made["number"] = made["number"].astype("Float64")
            yield pd.concat([frame[kept], made], axis=1)

    return read.mapInPandas(run, f"{schema}, {FEATURES}")


# --- pairs, as columns: ``a`` and ``b`` are structs of features, "b continues a" ---


def _choice(*rules: tuple[Column, str], otherwise: str = "none") -> Column:
    out = None
    for condition, kind in rules:
        out = F.when(condition, kind) if out is None else out.when(condition, kind)
    return out.otherwise(otherwise)


def time_kind(gap_s: Column, s: Linkage = LINKAGE) -> Column:
    gap = F.abs(gap_s)
    return _choice((gap <= s.close_s, "close"), (gap <= s.near_s, "near"), (gap > s.far_s, "far"), otherwise="apart")


def name_kind(a: Column, b: Column) -> Column:
    series = a["number"].isNotNull() & b["number"].isNotNull() & (a["is_copy"] == b["is_copy"]) & (a["stem"] == b["stem"])
    copy = b["is_copy"] & (b["stem"] == a["name"])
    back = a["is_copy"] & (a["stem"] == b["name"])
    return _choice((series & (b["number"] == a["number"] + 1), "next"), (series, "series"), (copy & b["number"].isin(*FIRST_COPIES), "next"), (copy | back, "series"), otherwise="unrelated")


def marker_kind(a: Column, b: Column) -> Column:
    start, of = b["start_page"], F.coalesce(b["start_of"], a["end_of"])
    return _choice(
        (start.isNull() & (a["end_page"] == a["end_of"]), "complete"),
        (start.isNull(), "none"),
        (start == 1, "restart"),
        (a["end_page"].isNull(), "none"),
        (b["start_of"] != a["end_of"], "conflict"),
        (start == a["end_page"] + 1, "consecutive"),
        (of.isNotNull(), "sameSet"),
    )


def shared_numbers(a: Column, b: Column) -> Column:
    """Numbers labelled on one and printed on the other: array of (label, value, plain), each number once."""
    both = F.concat(F.filter(a["labelled"], lambda x: F.array_contains(b["numbers"], x["plain"])), F.filter(b["labelled"], lambda x: F.array_contains(a["numbers"], x["plain"])))
    keys = F.array_distinct(F.transform(both, lambda x: x["plain"]))
    return F.transform(keys, lambda k: F.element_at(F.filter(both, lambda x: x["plain"] == k), -1))


def field_kind(a: Column, b: Column, same: Column) -> Column:
    return _choice((a.isNull(), "none"), (b.isNull(), "onlyFirst"), (same, "agree"), otherwise="conflict")


def same_vendor(a: Column, b: Column) -> Column:
    """One name is part of the other, by letters and digits alone."""
    x, y = (F.regexp_replace(F.lower(v), r"[^\p{L}0-9]+", "") for v in (a, b))
    return F.contains(x, y) | F.contains(y, x)


def flow_kind(a: Column, b: Column) -> Column:
    return _choice((a["ends_open"] & b["starts_lower"], "runsOn"), (b["opening"].isNotNull(), "freshStart"))


def vector_kind(a: Column, b: Column, s: Linkage = LINKAGE) -> Column:
    """By the cosine; none where a vector is missing or zero, or lengths differ."""
    from .search import cosine

    c = cosine(a["mean_embedding"], b["mean_embedding"])
    return _choice((c >= s.similar, "similar"), (c < s.dissimilar, "dissimilar"))


def gap_text(gap_s: Column) -> Column:
    gap = F.abs(gap_s)
    rounded = lambda unit, name: F.concat(F.floor(gap / unit + 0.5).cast("string"), F.lit(f" {name}"))
    return F.when(gap < 60, rounded(1, "s")).when(gap < 3600, rounded(60, "min")).otherwise(rounded(3600, "h"))


def marker_text(page: Column, of: Column) -> Column:
    return F.concat(F.lit("page "), page.cast("string"), F.coalesce(F.concat(F.lit(" of "), of.cast("string")), F.lit("")))


def pair_kinds(a: Column, b: Column, gap_s: Column, s: Linkage = LINKAGE) -> dict[str, tuple[Column, Column]]:
    """For each signal its kind and, for a reader, what it goes by."""
    end, start = marker_text(a["end_page"], a["end_of"]), marker_text(b["start_page"], b["start_of"])
    shared = shared_numbers(a, b)
    dates = F.concat_ws(" and ", a["document_date"].cast("string"), b["document_date"].cast("string"))
    vendors = F.concat_ws(" and ", a["vendor"], b["vendor"])
    return {
        "timeGap": (time_kind(gap_s, s), F.concat(F.lit("filed within "), gap_text(gap_s))),
        "filename": (name_kind(a, b), F.concat_ws(", then ", a["name"], b["name"])),
        "pageMarkers": (marker_kind(a, b), F.concat_ws(", then ", end, start)),
        "identifiers": (F.when(F.size(shared) > 0, "shared").otherwise("none"), F.array_join(F.transform(shared, lambda x: F.concat(x["label"], F.lit(" "), x["value"])), " and ")),
        "documentDate": (field_kind(a["document_date"], b["document_date"], a["document_date"] == b["document_date"]), F.concat(F.lit("dated "), dates)),
        "vendor": (field_kind(a["vendor"], b["vendor"], same_vendor(a["vendor"], b["vendor"])), F.concat(F.lit("from "), vendors)),
        "textFlow": (flow_kind(a, b), F.coalesce(F.when(a["ends_open"] & b["starts_lower"], F.lit("a sentence goes on")), F.concat(F.lit("begins with a "), b["opening"]))),
        "embedding": (vector_kind(a, b, s), F.lit("by content")),
    }


def scored(pairs: DataFrame, features: DataFrame, s: Linkage = LINKAGE) -> DataFrame:
    """(a, b, confidence, points, reasons) of pairs (a, b, gap_s); reasons are those that count, the strongest for first. No Python runs here."""
    columns = [c for c in features.columns if c != "id"]
    side = lambda c: features.select(F.col("id").alias(c), F.struct(*columns).alias(f"__{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    kinds = pair_kinds(F.col("__a"), F.col("__b"), F.col("gap_s"), s)
    rows = both.select("a", "b", *[x.alias(f"{p}_{k}") for k, (kind, text) in kinds.items() for p, x in (("kind", kind), ("text", text))])

    def weight(k: str) -> Column:
        return F.coalesce(F.create_map(*[F.lit(x) for pair in s.weights[k].items() for x in pair])[F.col(f"kind_{k}")], F.lit(0.0))

    points = F.lit(s.bias)
    for k in kinds:
        points = points + weight(k)
    every = F.array(*[F.struct(F.lit(k).alias("signal"), F.concat(F.col(f"kind_{k}"), F.lit(": "), F.coalesce(F.col(f"text_{k}"), F.lit(""))).alias("text"), weight(k).alias("points")) for k in kinds])
    places = F.sequence(F.lit(0), F.lit(len(kinds) - 1))
    ordered = F.array_sort(F.arrays_zip(F.transform(every, lambda r: -r["points"]).alias("minus"), places.alias("place"), every.alias("r")))
    reasons = F.transform(F.filter(ordered, lambda x: x["r"]["points"] != 0), lambda x: x["r"])
    return rows.select("a", "b", (1 / (1 + F.exp(-points))).alias("confidence"), points.alias("points"), reasons.alias("reasons"))
