"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A page is read into its leaf blocks: runs of text between block-level boundaries, each with the tags and
class words of its ancestors. The field labels the chain of blocks as article or not, from ancestor
features, text features and the label before, and is decoded by Viterbi. It is trained on labelled
pages (``labelled_pages`` makes a bounded set of them over many layouts: article, main or plain
containers; menus, headers, footers, side bars, notices, adverts, forms and reader comments around and inside
them), by stochastic gradient ascent on the likelihood. Text words are never features, so any
language works.

Null and empty pages have an empty text. A page is read forward once, so malformed pages cost no more than
others: a tag that never ends is dropped with what follows it, as browsers do, and so is a script, style or other element of raw text; a
drawing or list of choices without an end is only its tag; a comment that never ends stops at its
first ``>``; a quote that never ends is a plain character. Formulas and the text that stands in for an object are text. White space is what Unicode calls so, no-break
spaces included. Rows are treated one by one, so repeated rows, ties and other columns play no part; memory is
bounded by one page.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mapped, texts_of

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile("""[>"']""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+")
# Elements by how they are read.
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "select", "annotation", "annotation-xml", "head"}
RAW_TO_END = {"script", "style", "noscript", "template", "iframe", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "br", "object"}
INLINE |= set("math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mspace mpadded mphantom menclose mtable mtr mtd semantics".split())
#: Elements that most pages have around everything, so that they tell nothing.
AROUND_ALL = {"html", "body"}
CLOSES_ITSELF = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
P_STAYS_OPEN_IN = INLINE | {"input", "button"}
#: Elements inside elements up to which they are kept apart; deeper ones count as their ancestor at this depth.
DEEPEST = 512


@dataclass
class Block:
    """A leaf block: its text, the tags and class words above it, and how much of the text is in links."""

    text: str
    tags: tuple[str, ...]
    words: tuple[str, ...]
    linked: int


class _Reader:
    """The tags and texts of a page, read forward; what was once searched for to the end in vain is not searched for again."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def past(self, pattern: str, at: int) -> re.Match | None:
        """The next match of a pattern that ends an element."""
        if pattern in self.missing:
            return None
        found = re.compile(pattern, re.IGNORECASE).search(self.page, at)
        if found is None:
            self.missing.add(pattern)
        return found

    def skipped(self, at: int) -> int | None:
        """The end of the comment or declaration that begins at ``at``; None if a tag or text does."""
        page = self.page
        for begin, end in (("<!--", "-->"), ("<![CDATA[", "]]>")):
            if page.startswith(begin, at) and (found := self.find(end, at + 2 if begin == "<!--" else at)) >= 0:
                return found + 3
        if page.startswith(("<!", "<?"), at) or page.startswith("</", at) and not page[at + 2 : at + 3].isalpha():
            found = self.find(">", at)
            return found + 1 if found >= 0 else len(page)
        return None

    def tag_end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose name ends at ``at``, quoted values left out; -1 if there is none."""
        page = self.page
        while found := _STOP.search(page, at):
            if found[0] == ">":
                return found.start()
            value = page[at : found.start()].rstrip().endswith("=")
            end = self.find(found[0], found.end()) if value else -1
            at = end + 1 if end >= 0 else found.end()
        return -1


def leaf_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order; text is decoded, white space is one space."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked, in_link = 0, 0
    where: tuple | None = None
    at, n, reader = 0, len(page), _Reader(page)

    def flush() -> None:
        nonlocal parts, linked, where
        text = " ".join("".join(parts).split())
        if text and where is not None:
            out.append(Block(text, *where, min(linked, len(text))))
        parts, linked, where = [], 0, None

    def add(text: str) -> None:
        nonlocal linked, where
        if "&" in text:
            text = html.unescape(text)
        if where is None and not text.isspace():
            where = (tuple(t for t, _ in stack if t not in INLINE and t not in AROUND_ALL), tuple(w for _, ws in stack for w in ws))
        parts.append(text)
        if in_link:
            linked += len(text)

    while at < n:
        begin = reader.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        if begin > at:
            add(page[at:begin])
        if (end := reader.skipped(begin)) is not None:
            at = end
            continue
        closing = page.startswith("/", begin + 1)
        named = _NAME.match(page, begin + 1 + closing)
        if named is None:
            add("<")
            at = begin + 1
            continue
        end = reader.tag_end(named.end())
        if end < 0:
            break
        at, name, attributes = end + 1, named[0].lower(), page[named.end() : end]
        if closing:
            if name == "a":
                in_link = max(0, in_link - 1)
            if name not in INLINE:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    if name in INLINE:
                        del stack[i]
                    else:
                        del stack[i:]
                        in_link = sum(t == "a" for t, _ in stack)
                    break
            continue
        if name in RAW:
            if name == "head":
                flush()
                found = reader.past(r"</head\s*>|<body[\s>]", at)
                if found:
                    at = found.start() if found[0][1] != "/" else found.end()
                continue
            if not attributes.endswith("/") or name != "svg":
                found = reader.past(rf"</{name}\s*>", at)
                at = found.end() if found else n if name in RAW_TO_END else at
            continue
        if name == "br":
            add(" ")
            continue
        if name not in INLINE:
            flush()
            if name not in P_STAYS_OPEN_IN:
                for i in range(len(stack) - 1, -1, -1):
                    t = stack[i][0]
                    if t == "p" or t == name and name in CLOSES_ITSELF:
                        del stack[i:]
                        in_link = sum(x == "a" for x, _ in stack)
                        break
                    if t not in INLINE and t not in CLOSES_ITSELF:
                        break
        if name in VOID or len(stack) >= DEEPEST:
            continue
        words: tuple[str, ...] = ()
        if attributes:
            found = []
            for key, value in _ATTRIBUTE.findall(attributes):
                key = key.lower()
                if key in ("hidden", "aria-hidden") and value.strip("\"'").lower() != "false" or key == "style" and "display:none" in value.replace(" ", "").lower():
                    found.append("hidden")
                elif key in ("class", "id", "role"):
                    found += _WORDS.findall(value.lower())
            words = tuple(found)
        if name == "a":
            in_link += 1
        stack.append((name, words))
    flush()
    return out


def _size(block: Block) -> int:
    return min(6, int(math.log2(len(block.text) + 1)) // 2)


def chain_features(blocks: list[Block]) -> list[list[str]]:
    """The features of each block of a page: its own, its neighbours' sizes, and which of the page's landmarks it lies outside of."""
    marks = {t for b in blocks for t in b.tags} & {"article", "main"}
    out = []
    for i, b in enumerate(blocks):
        own = features(b)
        own += [f"out:{t}" for t in marks if t not in b.tags]
        own.append(f"before:{_size(blocks[i - 1])}" if i else "first")
        own.append(f"after:{_size(blocks[i + 1])}" if i + 1 < len(blocks) else "last")
        out.append(own)
    return out


def features(block: Block) -> list[str]:
    """Ancestor-tag, class-word and text features of a block."""
    text, n = block.text, len(block.text)
    share = block.linked / n if n else 0
    out = ["bias", f"size{_size(block)}", f"links{int(share * 3 + 0.5)}"]
    out += {f"t:{t}" for t in block.tags}
    out += {f"w:{w}" for w in block.words}
    if block.tags:
        out.append(f"in:{block.tags[-1]}")
    out.append("stop" if text[-1] in ".!?…:;\"'»”" else "nostop")
    if "©" in text[:40]:
        out.append("copyright")
    return out


class Field:
    """The field: a weight for each feature (article against not), and for each pair of labels."""

    def __init__(self):
        self.weight: dict[str, float] = defaultdict(float)
        self.step = [[0.0, 0.0], [0.0, 0.0]]

    def scores(self, chain: list[list[str]]) -> list[float]:
        get = self.weight.get
        return [sum([get(f, 0.0) for f in fs]) for fs in chain]

    def decode(self, chain: list[list[str]]) -> list[int]:
        """Viterbi; ties go to article."""
        if not chain:
            return []
        e = self.scores(chain)
        (s00, s01), (s10, s11) = self.step
        a, b, back = 0.0, e[0], []
        for x in e[1:]:
            to0, to1 = (0, a + s00) if a + s00 > b + s10 else (1, b + s10), (0, a + s01) if a + s01 > b + s11 else (1, b + s11)
            back.append((to0[0], to1[0]))
            a, b = to0[1], to1[1] + x
        out = [1 if b >= a else 0]
        for way in reversed(back):
            out.append(way[out[-1]])
        return out[::-1]

    def learn(self, chain: list[list[str]], labels: list[int], rate: float, shrink: float) -> None:
        """One step up the gradient of the log likelihood, by forward-backward."""
        e, n = self.scores(chain), len(chain)
        add = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
        f = [(0.0, e[0])]
        for x in e[1:]:
            a, b = f[-1]
            f.append((add(a + self.step[0][0], b + self.step[1][0]), add(a + self.step[0][1], b + self.step[1][1]) + x))
        g = [(0.0, 0.0)]
        for x in reversed(e[1:]):
            a, b = g[-1][0], g[-1][1] + x
            g.append((add(self.step[0][0] + a, self.step[0][1] + b), add(self.step[1][0] + a, self.step[1][1] + b)))
        g.reverse()
        z = add(*f[-1])
        moves = [[0.0, 0.0], [0.0, 0.0]]
        for i in range(n):
            p = math.exp(min(0.0, f[i][1] + g[i][1] - z))
            d = rate * (labels[i] - p)
            for x in chain[i]:
                self.weight[x] += d - shrink * self.weight[x]
            if i:
                for a in (0, 1):
                    for b in (0, 1):
                        q = math.exp(min(0.0, f[i - 1][a] + self.step[a][b] + (e[i] if b else 0.0) + g[i][b] - z))
                        moves[a][b] += (labels[i - 1] == a and labels[i] == b) - q
        for a in (0, 1):
            for b in (0, 1):
                self.step[a][b] += rate * moves[a][b] - shrink * self.step[a][b]


# Names that page authors give to parts that are not the article, and to those that are.
ASIDE_NAMES = {
    "nav": "nav menu navbar navigation breadcrumb breadcrumbs topbar tabs pagination pager toc skip",
    "head": "header masthead banner branding logo sitehead topnav",
    "foot": "footer foot copyright colophon legal bottom imprint",
    "side": "sidebar side aside widget related recommended trending popular more rail",
    "note": "cookie cookies consent notice alert gdpr popup modal overlay message warning toast hidden",
    "ad": "ad ads advert advertisement adsense sponsor sponsored promo promotion banner dfp",
    "form": "form newsletter subscribe signup login search share social sharing buttons follow",
    "talk": "comments comment discussion replies reply respond disqus thread reviews responses",
}
CHAPTER_NAMES = "chapter section part intro introduction background method results conclusion summary".split()
WRAPPER_NAMES = "wrapper container layout page site row column grid inner outer wrap".split()
ARTICLE_NAMES = "article content post entry story main body text page hentry single prose primary".split()


def labelled_pages(n: int = 700, seed: int = 7) -> Iterator[tuple[str, list[int]]]:
    """Pages with the label of each leaf block, over many layouts; deterministic."""
    rng = random.Random(seed)

    def sentence(least: int, most: int, stop: bool = True) -> str:
        words = ["".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(least, most))]
        return " ".join(words).capitalize() + (rng.choice(".!?") if stop and rng.random() < 0.92 else "")

    def link(least: int = 1, most: int = 3) -> str:
        return f'<a href="/x">{sentence(least, most, False)}</a>'

    def attribute(kind: str) -> str:
        names = ASIDE_NAMES[kind].split()
        return rng.choice([f' class="{rng.choice(names)}"', f' id="{rng.choice(names)}"', f' class="{rng.choice(names)} box"'])

    def other(kind: str) -> tuple[str, int]:
        tag = {"nav": "nav", "head": "header", "foot": "footer", "side": "aside", "form": "form", "talk": "section"}.get(kind, "div")
        named = attribute(kind) if tag in ("div", "section") or rng.random() < 0.5 else ""
        if rng.random() < 0.4 and tag != "div":
            tag, named = "div", attribute(kind)
        if kind == "nav" or kind == "side" and rng.random() < 0.5:
            k = rng.randint(2, 7)
            inner, blocks = "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(k)) + "</ul>", k
        elif kind == "talk":
            k = rng.randint(1, 4)
            inner, blocks = "".join(f"<{t}>{sentence(3, 40)}</{t}>" for t in rng.choices(["p", "div"], k=k)), k
        elif kind == "foot":
            inner, blocks = f"&copy; {sentence(1, 3, False)} &middot; {sentence(2, 8)}", 1
            if rng.random() < 0.3:
                inner, blocks = f"<p>{sentence(4, 20)}</p><p>{inner}</p>", 2
        elif kind == "form":
            inner, blocks = f"<label>{sentence(1, 4, False)}</label><input name=q><button>{sentence(1, 2, False)}</button>", 2
        elif kind == "head":
            inner, blocks = rng.choice([f"<h1>{sentence(1, 5, False)}</h1>", f"<div>{sentence(1, 5, False)}</div>"]), 1
        else:
            inner, blocks = rng.choice([(sentence(1, 25, rng.random() < 0.6), 1), (f"<p>{sentence(3, 25)}</p><p>{link(1, 5)}</p>", 2), (f"<p>{sentence(1, 4, False)} {link(1, 3)}</p>", 1)])
        return f"<{tag}{named}>{inner}</{tag}>", blocks

    def body(bare: bool, first: bool, paragraph: str) -> tuple[str, int]:
        out, k = "", 0
        if rng.random() < (0.1 if not first else 0.4 if bare else 0.9):
            out, k = f"<h1>{sentence(2, 12, rng.random() < 0.6)}</h1>", 1
        for _ in range(rng.randint(1, 2 if bare else 9)):
            x = rng.random()
            if x < 0.78:
                t = sentence(1, 80) if rng.random() < 0.8 else sentence(1, 6)
                if rng.random() < 0.2:
                    t += " " + link() + " " + sentence(1, 9)
                out, k = out + f"<{paragraph}>{t}</{paragraph}>", k + 1
            elif x < 0.85:
                out, k = out + f"<h2>{sentence(1, 8, False)}</h2>", k + 1
            elif x < 0.9:
                out, k = out + f"<blockquote>{sentence(5, 30)}</blockquote>", k + 1
            elif x < 0.92:
                out, k = out + f"<figure><img src=x><figcaption>{sentence(2, 15)}</figcaption></figure>", k + 1
            elif x < 0.94:
                out, k = out + f"<table><tr><th>{sentence(1, 3, False)}</th><td>{sentence(1, 6, False)}</td></tr></table>", k + 2
            elif x < 0.97:
                m = rng.randint(2, 4)
                out, k = out + "<ul>" + "".join(f"<li>{sentence(2, 12)}</li>" for _ in range(m)) + "</ul>", k + m
            else:
                out, k = out + f"<pre>{sentence(3, 20)}</pre>", k + 1
        return out, k

    def opened() -> tuple[str, str]:
        """The elements around an article, as sites have them; sections may be any part of it."""
        x, name = rng.random(), f' class="{rng.choice(ARTICLE_NAMES)}"'
        if x < 0.3:
            inner = [f"article{name if rng.random() < 0.3 else ''}"]
        elif x < 0.42:
            inner = ["main"]
        elif x < 0.5:
            inner = ["main", "article"]
        elif x < 0.68:
            inner = [f"div{name}" if rng.random() < 0.7 else f'div id="{rng.choice(ARTICLE_NAMES)}"']
        elif x < 0.78:
            inner = ["div"]
        elif x < 0.9:
            inner = [rng.choice(["section", f"section{name}", "section"])]
            if rng.random() < 0.5:
                inner.insert(0, rng.choice(["main", "div", f"div{name}"]))
        else:
            inner = []
        if rng.random() < 0.3:
            inner.insert(0, rng.choice(["div", f'div class="{rng.choice(WRAPPER_NAMES)}"', f'div id="{rng.choice(WRAPPER_NAMES)}"']))
        return "".join(f"<{t}>" for t in inner), "".join(f"</{t.split()[0]}>" for t in reversed(inner))

    for _ in range(n):
        whole, bare = rng.random(), rng.random() < 0.15  # a short page, with little or nothing around the article
        page, labels = "<!DOCTYPE html><html><head><title>x</title></head><body>" if whole < 0.8 else "<html>" if whole < 0.85 else "<body>" if whole < 0.9 else "", []

        def put(kinds: list[str], chance: float) -> None:
            nonlocal page
            for kind in kinds:
                if rng.random() < (chance / 6 if bare else chance):
                    text, k = other(kind)
                    page += text
                    labels.extend([0] * k)

        paragraph = "div" if rng.random() < 0.2 else "p"
        # one element around the whole page
        around = rng.choice(WRAPPER_NAMES) if rng.random() < 0.2 else ""
        if around:
            page += f'<div class="{around}">' if rng.random() < 0.5 else f'<div id="{around}">'
        put(["note", "head", "nav", "ad", "side", "form"], 0.45)
        open_, close = opened()
        page += open_
        chapters = rng.random() < 0.3
        for part in range(1 if bare else rng.randint(1, 4)):
            if part:
                put(["ad", "side", "form", "note"], 0.25)
            text, k = body(bare, not part, paragraph)
            if chapters and (part or rng.random() < 0.5):
                text = rng.choice([f"<section>{text}</section>", f'<section class="{rng.choice(CHAPTER_NAMES)}">{text}</section>', f'<section id="{rng.choice(CHAPTER_NAMES)}">{text}</section>'])
            page += text
            labels.extend([1] * k)
        if rng.random() < 0.35:
            put(["talk", "form", "side", "ad"], 0.5)
        page += close
        put(["talk", "side", "ad", "form", "nav", "foot"], 0.5)
        yield page + ("</div>" if around else "") + ("</body></html>" if whole < 0.8 and rng.random() < 0.9 else ""), labels


def train(pages: Iterator[tuple[str, list[int]]] | None = None, rounds: int = 12, rate: float = 0.15, shrink: float = 1e-4, seed: int = 3) -> Field:
    """Fits the field on labelled pages (a bounded set made here, unless given)."""
    chains = []
    for page, labels in pages if pages is not None else labelled_pages():
        blocks = leaf_blocks(page)
        if len(blocks) != len(labels):
            raise ValueError(f"{len(labels)} labels for {len(blocks)} blocks")
        if blocks:
            chains.append((chain_features(blocks), labels))
    field, rng = Field(), random.Random(seed)
    for k in range(rounds):
        rng.shuffle(chains)
        for chain, labels in chains:
            field.learn(chain, labels, rate / (1 + k / 4), shrink)
    field.weight = dict(field.weight)
    return field


def main_text(page: str, field: Field) -> str:
    """The article's blocks, one a line."""
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, y in zip(blocks, field.decode(chain_features(blocks)), strict=True) if y)


def extract(pages: DataFrame, field: Field | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, text) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(field or train())

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array([main_text(p, shared.value) for p in texts_of(part)], pa.string())], ["id", "text"])

    return mapped(pages, run, f"id {pages.schema[id_col].dataType.simpleString()}, text string", id_col, html_col)


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; the url travels with its page, so nothing is joined."""
    from pyspark.sql import functions as F

    keyed = pages.select(F.struct("page_id", "url").alias("key"), "html")
    shared = pages.sparkSession.sparkContext.broadcast(train())

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("id"), pa.array([main_text(p, shared.value) for p in texts_of(part)], pa.string())], ["id", "text"])

    rows = mapped(keyed, run, f"id {keyed.schema['key'].dataType.simpleString()}, text string", "key", "html")
    return rows.select("id.page_id", "id.url", "text", F.length("text").cast("long").alias("n_chars"))
