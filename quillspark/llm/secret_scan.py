"""Secret scans: all rules as one deterministic automaton, run once over the bytes of a text.

The rule expressions are compiled together: a Thompson automaton for each, the subset
construction over the union, then minimisation by partition refinement. What runs is a
transition array over byte classes. The automaton reads a text once, from its last byte to its first, and so
knows at every byte for which rules a match begins there. From each such start, left to right and
not inside the match before, the rule's own forward automaton is stepped to the longest end; a second one, of what
stands before the measured part, tells that part's length. Only a private key's end is read by its expression, as it
must repeat the label of its beginning, which no automaton can ask for.

Empty and null texts have no spans. Rows are treated one by one, so repeated rows, ties and
other columns play no part; memory is bounded by one text.
"""

from __future__ import annotations

import re
from re import _constants as C
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, bytes_of, mapped, pieces

# The base rules. (kind, expression, group that is measured, its least length)
BASE_RULES = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]+", 0, 32),
)
_QUOTES = r"""[\x20\t>"'|*#,;]*+"""
_BREAK = rf"(?:{_QUOTES}(?:\r?\n|\\[rn]))++{_QUOTES}"  # ends of lines, real or escaped, with what quotes lines
#: A private key from BEGIN to its END; if that is missing, to the end of the header fields and base64 lines that follow.
PRIVATE_KEY = (
    r"-----BEGIN ([A-Z ]*)PRIVATE KEY-----(?:"
    r"[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END \1PRIVATE KEY-----"
    rf"|(?:{_BREAK}(?:Proc-Type|DEK-Info):[^\r\n\\]*+)*+"
    rf"(?:(?:[\x20\t]*+|{_BREAK})[A-Za-z0-9+/=]{{16,}}+|{_BREAK}[A-Za-z0-9+/=]++(?=[\x20\t]*+(?:[\r\n\"']|\\[rn]|\Z)))*+)"
)
#: Rules that this scan adds, in the same form; a least length of 0 asks nothing.
MORE_RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    ("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    ("pem", PRIVATE_KEY, 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 0),
)
RULES = BASE_RULES + MORE_RULES
#: What the automaton looks for: for each rule an expression that begins where the rule's matches do. Runs of hex digits are
#: sought by their least length, since every start in a shorter run fails and ends with it.
SOUGHT = {
    "assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]""",
    "access": r"AKIA[A-Z0-9]",
    "hex": r"[0-9a-f]{32}",
    "github": r"gh[pousr]_[A-Za-z0-9]",
    "slack": r"xox[abprs]-[A-Za-z0-9-]",
    "google": r"AIza[A-Za-z0-9_-]",
    "pem": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]",
}
#: What stands before the measured part, where that is not the whole match.
AHEAD = {"assign": r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?"""}


class _Nfa:
    """Thompson's construction over bytes; ``backward`` for texts that are read from their end."""

    def __init__(self, backward: bool):
        self.backward = backward
        self.step: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.step.append([])
        self.free.append([])
        return len(self.step) - 1

    def build(self, tree, start: int, fold: bool) -> int:
        for op, arg in reversed(list(tree)) if self.backward else tree:
            start = self.node(op, arg, start, fold)
        return start

    def eat(self, start: int, chars, fold: bool) -> int:
        chars = set(chars)
        if fold:
            chars |= {b ^ 32 for b in chars if chr(b).isascii() and chr(b).isalpha()}
        end = self.state()
        self.step[start].append((frozenset(chars), end))
        return end

    def node(self, op, arg, start: int, fold: bool) -> int:
        if op is C.LITERAL:
            return self.eat(start, [arg], fold)
        if op is C.IN:
            chars = set()
            for kind, value in arg:
                chars |= {value} if kind is C.LITERAL else set(range(value[0], value[1] + 1))
            return self.eat(start, chars, fold)
        if op is C.SUBPATTERN:
            return self.build(arg[3], start, bool(arg[1] & re.IGNORECASE) or fold)
        if op is C.BRANCH:
            end = self.state()
            for way in arg[1]:
                first = self.state()
                self.free[start].append(first)
                self.free[self.build(way, first, fold)].append(end)
            return end
        if op is C.MAX_REPEAT:
            least, most, tree = arg
            for _ in range(least):
                start = self.build(tree, start, fold)
            if most is C.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.free[start].append(loop)
                self.free[self.build(tree, loop, fold)].append(loop)
                self.free[loop].append(end)
                return end
            end = self.state()
            for _ in range(most - least):
                self.free[start].append(end)
                start = self.build(tree, start, fold)
            self.free[start].append(end)
            return end
        raise ValueError(f"the automaton has no {op}")

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


class Automaton:
    """``table[state + class]`` is the next state, already times the number of classes; states from ``accept`` on accept."""

    def __init__(self, classes: bytes, table: list[int], start: int, accept: int, masks: dict[int, int], dead: int):
        self.classes, self.table, self.start, self.accept, self.masks, self.dead = classes, table, start, accept, masks, dead

    def starts(self, data: bytes) -> list[tuple[int, int]]:
        """One pass over the bytes, from the last: (place, a bit for each rule of which a match begins there), last first."""
        table, s, accept, out, at = self.table, self.start, self.accept, [], len(data)
        for c in data.translate(self.classes)[::-1]:
            at -= 1
            s = table[s + c]
            if s >= accept:
                out.append((at, self.masks[s]))
        return out

    def longest(self, data: bytes, start: int) -> int:
        """The end of the longest match that begins at ``start``, or -1."""
        table, s, accept, dead, classes = self.table, self.start, self.accept, self.dead, self.classes
        end = start if s >= accept else -1
        for at in range(start, len(data)):
            s = table[s + classes[data[at]]]
            if s >= accept:
                end = at + 1
            elif s == dead:
                break
        return end


def compile_rules(patterns: list[str], backward: bool = True) -> Automaton:
    """Subset construction over all rules, then minimisation: backward and from any place, or forward from one start."""
    nfa, final = _Nfa(backward), {}
    root = nfa.state()
    for i, pattern in enumerate(patterns):
        first = nfa.state()
        nfa.free[root].append(first)
        final[nfa.build(_parser.parse(pattern), first, False)] = 1 << i
    # byte classes: bytes that no rule tells apart
    sets = {chars for steps in nfa.step for chars, _ in steps}
    kinds: dict[tuple, int] = {}
    classes = bytes(kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256))
    sample = {c: b for b, c in reversed(list(enumerate(classes)))}
    width = len(kinds)
    begin = nfa.closure([root])
    number, todo, rows = {begin: 0}, [begin], []
    while todo:
        now = todo.pop(0)
        row = []
        for c in range(width):
            to = nfa.closure({e for s in now for chars, e in nfa.step[s] if sample[c] in chars} | ({root} if backward else set()))
            if to not in number:
                number[to] = len(number)
                todo.append(to)
            row.append(number[to])
        rows.append(row)
    masks = [0] * len(number)
    for states, n in number.items():
        for s in states:
            masks[n] |= final.get(s, 0)
    # minimisation: blocks are refined until all states of one lead to the same blocks
    block, count = masks, 0
    while True:
        names: dict[tuple, int] = {}
        block = [names.setdefault((block[s], *(block[t] for t in rows[s])), len(names)) for s in range(len(rows))]
        if len(names) == count:
            break
        count = len(names)
    one = {b: s for s, b in reversed(list(enumerate(block)))}
    order = sorted(one, key=lambda b: (masks[one[b]] > 0, b))
    at = {b: i for i, b in enumerate(order)}
    table = [at[block[t]] * width for b in order for t in rows[one[b]]]
    plain = sum(not masks[one[b]] for b in order)
    dead = block[number[frozenset()]] if frozenset() in number else None
    return Automaton(classes, table, at[block[0]] * width, plain * width, {at[b] * width: masks[one[b]] for b in order if masks[one[b]]}, -1 if dead is None else at[dead] * width)


class Scanner:
    """The automata of all rules: one that finds where matches begin, and for each rule those that find where it ends."""

    def __init__(self, rules=RULES):
        self.rules = rules
        self.machine = compile_rules([SOUGHT[k] for k, *_ in rules])
        self.whole = [None if pattern is PRIVATE_KEY else compile_rules([pattern], False) for _, pattern, _, _ in rules]
        self.ahead = [compile_rules([AHEAD[k]], False) if k in AHEAD else None for k, *_ in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, place of the kind, end), leftmost and not overlapping within a kind; in code points."""
        starts = self.machine.starts(data)
        if not starts:
            return []
        free, out = [0] * len(self.rules), []
        for at, mask in reversed(starts):
            while mask:
                i = (mask & -mask).bit_length() - 1
                mask &= mask - 1
                if at < free[i]:
                    continue
                if self.whole[i] is None:
                    tail = data[at:].decode()
                    end = at + len(tail[: re.match(PRIVATE_KEY, tail).end()].encode())
                else:
                    end = self.whole[i].longest(data, at)
                free[i] = end
                measured = self.ahead[i].longest(data, at) if self.ahead[i] else at
                if end - measured >= self.rules[i][3]:
                    out.append((at, i, end))
        if len(data) == 0 or data.isascii() or not out:
            return out
        places = sorted({x for s, _, e in out for x in (s, e)})
        points, seen, before = {}, 0, 0
        for x in places:
            seen += len(data[before:x].decode())
            points[x], before = seen, x
        return [(points[s], i, points[e]) for s, i, e in out]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Finds secrets: (id, kinds array<string>, starts array<int>, ends array<int>), in order of start, then kind.

    One row per input row; a text without secrets, empty or null has empty arrays. Offsets are code points.
    """
    shared = df.sparkSession.sparkContext.broadcast(Scanner())
    names = [k for k, *_ in RULES]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        scanner, kinds, starts, ends = shared.value, [], [], []
        for data in bytes_of(part):
            spans = scanner.spans(data)
            kinds.append([names[i] for _, i, _ in spans])
            starts.append([s for s, _, _ in spans])
            ends.append([e for _, _, e in spans])
        return pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array(kinds, pa.list_(pa.string())), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32()))],
            ["id", "kinds", "starts", "ends"],
        )

    kind = df.schema[id_col].dataType.simpleString()
    return mapped(df, run, f"id {kind}, kinds array<string>, starts array<int>, ends array<int>", id_col, text_col)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The table with each secret in ``text_col`` replaced by ``mask``; overlapping spans make one. Null stays null."""
    from pyspark.sql import functions as F

    shared = df.sparkSession.sparkContext.broadcast(Scanner())

    def run(batches):
        for batch in (part for whole in batches for part in pieces(whole, text_col)):
            texts = []
            for text in batch.column(0).to_pylist():
                spans = shared.value.spans(text.encode()) if text else []
                if spans:
                    out, at = [], 0
                    for s, _, e in spans:
                        if s >= at:
                            out += [text[at:s], mask]
                        at = max(at, e)
                    text = "".join([*out, text[at:]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], batch.schema.names)

    names = [f.name for f in df.schema.fields]
    rest = [c for c in names if c != text_col]
    shaped = df.select(F.col(text_col), *rest)
    bounded_batches(df.sparkSession)
    return shaped.mapInArrow(run, shaped.schema).select(*names)


def secret_digests(df: DataFrame) -> DataFrame:
    """The digest columns of ``scan`` for a table with doc_id and text."""
    from pyspark.sql import functions as F

    base = [k for k, *_ in BASE_RULES]
    zipped = F.transform(F.arrays_zip("kinds", "starts", "ends"), lambda x: F.struct(x["kinds"].alias("k"), F.concat_ws(":", x["kinds"], x["starts"], x["ends"]).alias("s")))
    rows = scan(df).withColumn("z", zipped)
    count = lambda k: F.size(F.filter("kinds", lambda x: x == k)).cast("long").alias(f"n_{k}")
    return rows.select(
        F.col("id").alias("doc_id"),
        *[count(k) for k in base],
        F.sha2(F.concat_ws(",", F.transform(F.filter("z", lambda x: x["k"].isin(base)), lambda x: x["s"])), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("z", lambda x: x["s"])).alias("spans"),
    )
