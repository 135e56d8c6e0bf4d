"""Bytes to text: character sets, HTML, e-books, media types. Per-row helpers and the UDFs around them."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Magic numbers as hex, and extensions, of the accepted media types.
MAGIC = (("25504446", 1, "application/pdf"), ("89504E470D0A1A0A", 1, "image/png"), ("FFD8FF", 1, "image/jpeg"), ("49492A00", 1, "image/tiff"), ("4D4D002A", 1, "image/tiff"), ("474946383761", 1, "image/gif"), ("474946383961", 1, "image/gif"))
EXTENSIONS = {"pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "tif": "image/tiff", "tiff": "image/tiff", "webp": "image/webp", "gif": "image/gif", "txt": "text/plain", "md": "text/markdown", "markdown": "text/markdown", "csv": "text/csv", "html": "text/html", "htm": "text/html", "epub": "application/epub+zip"}
# Types of uploads by extension where a browser has none, and other names for a type.
TYPES_BY_EXTENSION = {"epub": "application/epub+zip", "md": "text/markdown", "markdown": "text/markdown", "csv": "text/csv", "htm": "text/html", "html": "text/html"}
TYPE_ALIASES = {"text/x-markdown": "text/markdown", "application/csv": "text/csv", "text/x-csv": "text/csv", "application/x-csv": "text/csv", "text/comma-separated-values": "text/csv", "application/xhtml+xml": "text/html"}
SNIFF_BYTES = 4100
TEXT_TYPES = ("text/plain", "text/markdown", "text/csv")


def sniff(head: Column, claimed: Column) -> Column:
    """The media type by the first bytes; text types are only believed when claimed; null if not accepted."""
    at = lambda code, start: F.hex(F.substring(head, start, len(code) // 2)) == code
    out = F.when(at(MAGIC[0][0], MAGIC[0][1]), MAGIC[0][2])
    for code, start, mime in MAGIC[1:]:
        out = out.when(at(code, start), mime)
    out = out.when(at("52494646", 1) & (F.hex(F.substring(head, 9, 4)) == "57454250"), "image/webp")
    out = out.when(at("504B0304", 1) & (F.hex(F.substring(head, 31, 28)) == b"mimetypeapplication/epub+zip".hex().upper()), "application/epub+zip")
    binary = at("504B0304", 1) | at("1F8B", 1) | (F.instr(F.hex(F.substring(head, 1, 64)), "00000000") > 0)
    return out.when(claimed.isin(*TEXT_TYPES, "text/html") & ~binary, claimed)


def claimed_type(path: Column) -> Column:
    """The media type that a file's extension claims."""
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.create_map(*[F.lit(x) for kv in EXTENSIONS.items() for x in kv])[ext]


def text_encoding(data: bytes, is_html: bool = False) -> str:
    """By mark, valid UTF-8, unmarked UTF-16, HTML's own word, a guess, else windows-1252."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if data.startswith(mark):
            return name
    if b"\0" not in data:
        try:
            data.decode("utf-8")
            return "utf-8"
        except UnicodeDecodeError:
            pass
    sample = data[:65_536]
    even, odd, units = sample[::2].count(0), sample[1::2].count(0), max(1, len(sample) // 2)
    if max(even, odd) * 10 >= units and max(even, odd) >= 20 * max(1, min(even, odd)):
        return "utf-16-be" if even > odd else "utf-16-le"
    if is_html and (m := re.search(rb"<meta[^>]+charset\s*=\s*[\"']?([\w-]+)", data[:1024], re.IGNORECASE)):
        name = m[1].decode().lower()
        try:
            "".encode(name)
            if not name.startswith("utf-16"):
                return name
        except LookupError:
            pass
    try:
        from charset_normalizer import from_bytes

        if (best := from_bytes(sample).best()) is not None:
            return best.encoding
    except ImportError:
        pass
    return "cp1252"


def decode_text(data: bytes | None, is_html: bool = False) -> str | None:
    if data is None:
        return None
    text = data.decode(text_encoding(data, is_html), errors="replace")
    return text.removeprefix("﻿")


@F.pandas_udf(T.StringType())
def decode_udf(data: pd.Series, mime: pd.Series) -> pd.Series:
    return pd.Series([decode_text(d, m == "text/html") for d, m in zip(data, mime, strict=True)], dtype=object)


# Elements that end a paragraph, and those that are not text.
BLOCKS = set("address article aside blockquote body caption dd details div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main ol p pre section summary table tr ul".split())
SKIPPED = set("head script style noscript template svg title".split())
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())


class _Sections(HTMLParser):
    """Headed sections of a page: (heading, level, paragraphs)."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.sections: list[list] = [[None, 0, []]]
        self.line, self.skip, self.heading, self.hidden, self.started = [], 0, 0, [], False

    def flush(self) -> None:
        text = "\n".join(x for x in (re.sub(r"[ \t\r\f\v\n]+", " ", part).strip() for part in "".join(self.line).split("\x00")) if x)
        self.line, self.started = [], False
        if not text:
            return
        if self.heading:
            self.sections.append([text.replace("\n", " "), self.heading, []])
        else:
            self.sections[-1][2].append(text)

    def handle_starttag(self, tag, attrs):
        given = dict(attrs)
        hide = tag in SKIPPED or "hidden" in given or "display:none" in (given.get("style") or "").replace(" ", "").lower()
        if tag in _VOID:
            if tag == "br":
                self.line.append("\x00")
            elif tag == "hr":
                self.flush()
            return
        self.hidden.append((tag, hide))
        self.skip += hide
        if self.skip:
            return
        if tag in BLOCKS:
            self.flush()
            if re.fullmatch("h[1-6]", tag):
                self.heading = int(tag[1])
        elif tag in ("td", "th"):
            self.line.append(" ")

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.hidden):
            return
        while self.hidden:
            t, hide = self.hidden.pop()
            self.skip -= hide
            if t == tag:
                break
        if tag in BLOCKS and not self.skip:
            self.flush()
            if re.fullmatch("h[1-6]", tag):
                self.heading = 0

    def handle_data(self, data):
        if not self.skip:
            self.line.append(data)


def html_sections(page: str) -> list[tuple[str | None, int, str]]:
    parser = _Sections()
    parser.feed(page)
    parser.close()
    parser.flush()
    return [(h, level, "\n\n".join(ps)) for h, level, ps in parser.sections if h or ps]


def sections_text(sections: list[tuple[str | None, int, str]]) -> str:
    """Sections joined by blank lines, each below its heading line."""
    return "\n\n".join("\n\n".join(x for x in (f"{'#' * level} {h}" if h else "", text) if x) for h, level, text in sections)


def html_text(page: str | None) -> str | None:
    return None if page is None else sections_text(html_sections(page))


@F.pandas_udf(T.StringType())
def html_text_udf(page: pd.Series) -> pd.Series:
    return page.map(html_text)


def read_epub(data: bytes, most_bytes: int = 200 << 20) -> list[tuple[str | None, int, str]]:
    """(heading, level, text) of an e-book's sections in reading order; protected or oversized books are errors."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        if sum(i.file_size for i in book.infolist()) > most_bytes:
            raise ValueError("the e-book unpacks to too many bytes")
        names = set(book.namelist())
        if "META-INF/encryption.xml" in names and b"EncryptedData" in book.read("META-INF/encryption.xml") and b"font" not in book.read("META-INF/encryption.xml").lower():
            raise ValueError("the e-book is protected")
        box = ElementTree.fromstring(book.read("META-INF/container.xml"))
        opf = next(e.attrib["full-path"] for e in box.iter() if e.tag.endswith("rootfile"))
        package, base = ElementTree.fromstring(book.read(opf)), posixpath.dirname(opf)
        items = {e.attrib["id"]: e.attrib for e in package.iter() if e.tag.endswith("}item")}
        out = []
        for ref in (e for e in package.iter() if e.tag.endswith("itemref")):
            item = items.get(ref.attrib.get("idref", ""))
            if not item or "html" not in item.get("media-type", "") or "nav" in item.get("properties", "").split():
                continue
            path = posixpath.normpath(posixpath.join(base, unquote(item["href"])))
            if path in names:
                out += html_sections(decode_text(book.read(path), True) or "")
        return out


@F.pandas_udf(T.ArrayType(T.StructType().add("heading", T.StringType()).add("level", T.IntegerType()).add("text", T.StringType())))
def epub_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else [{"heading": h, "level": n, "text": t} for h, n, t in read_epub(d)])


def epub_cover(data: bytes, most_bytes: int = 20 << 20) -> bytes | None:
    """The image that an e-book's package names as its cover: by property, else by the older meta element; none if it is too large."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        sizes = {i.filename: i.file_size for i in book.infolist()}
        if "META-INF/container.xml" not in sizes:
            return None
        opf = next((e.attrib["full-path"] for e in ElementTree.fromstring(book.read("META-INF/container.xml")).iter() if e.tag.endswith("rootfile")), None)
        if opf not in sizes:
            return None
        elements = list(ElementTree.fromstring(book.read(opf)).iter())
        items = [e.attrib for e in elements if e.tag.endswith("}item")]
        named = next((e.attrib.get("content") for e in elements if e.tag.endswith("}meta") and e.attrib.get("name") == "cover"), None)
        item = next((i for i in items if "cover-image" in i.get("properties", "").split()), None) or next((i for i in items if named is not None and i.get("id") == named), None)
        if not item or not item.get("href") or not item.get("media-type", "").startswith("image/"):
            return None
        path = posixpath.normpath(posixpath.join(posixpath.dirname(opf), unquote(item["href"])))
        return book.read(path) if sizes.get(path, most_bytes + 1) <= most_bytes else None


@F.pandas_udf(T.BinaryType())
def epub_cover_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else epub_cover(d))


def upload_type(name: Column, given: Column) -> Column:
    """The media type of an upload: what the browser says, other names of a type put right, else by the extension."""
    extension = F.lower(F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit("")))
    renamed, by_extension = given, F.lit("application/octet-stream")
    for other, usual in TYPE_ALIASES.items():
        renamed = F.when(given == other, usual).otherwise(renamed)
    for ending, kind in TYPES_BY_EXTENSION.items():
        by_extension = F.when(extension == ending, kind).otherwise(by_extension)
    spreadsheet = (given == "application/vnd.ms-excel") & (extension == "csv")
    return F.when(spreadsheet, "text/csv").when(F.coalesce(given, F.lit("")) != "", renamed).otherwise(by_extension)


def title_from_filename(name: Column, most: int = 500) -> Column:
    return F.substring(F.replace(F.regexp_replace(name, r"(?<=.)\.[^./]*$", ""), F.lit("/"), F.lit("-")), 1, most)


def safe_name(name: Column) -> Column:
    """A name for any file system: control and reserved characters become _, dots and spaces at the end go."""
    clean = F.regexp_replace(F.regexp_replace(name, r'[\x00-\x1F\x7F<>:"/\\|?*]', "_"), r"[. ]+$", "")
    return F.when(clean == "", "_").otherwise(clean)


def folder_name_ok(name: Column) -> Column:
    return name.rlike(r"^[\p{L}\p{N}_][\p{L}\p{N} _.\-]*$") & (F.length(name) <= 64)


def normal_path(path: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(path, "/"), lambda p: F.trim(p)), lambda p: p != ""), "/")
