"""Suffix trees, periodic runs and prefix tries against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quillspark.llm.periodic_runs import EndSet, planted, run_digests, runs_in, stretches, suffix_automaton, word_runs
from quillspark.llm.prefix_trie import conversation_turns, prefix_trie, rebuilt, rebuilt_trie
from quillspark.llm.suffix_tree import Subtree, maximal_repeats, repeats_removed, substring_report


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# periodic runs


def brute_runs(w, least, times):
    """Every period tried at every place."""
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(least, times * q):
                out.setdefault((s, i + q - s), q)
    return sorted((s, n, q) for (s, n), q in out.items())


def loopy(rng, most=120):
    a = rng.choice([1, 2, 3, 5])
    w = [rng.randrange(a) for _ in range(rng.randint(0, most))]
    for _ in range(rng.randint(0, 3)):
        p, at = rng.randint(1, 12), rng.randint(0, len(w))
        w[at:at] = ([rng.randrange(a + 1) for _ in range(p)] * 20)[: rng.randint(p, 8 * p)]
    return w


def test_end_sets_stay_in_order():
    rng = random.Random(1)
    places = rng.sample(range(10_000), 3000)
    held = EndSet(places[0])
    for i, x in enumerate(places[1:], 1):
        told = held.add(x)
        if i % 97 == 0:
            some = places[:i]
            assert told == (max((y for y in some if y < x), default=-1), min((y for y in some if y > x), default=-1))
    assert list(held) == sorted(places) and held.size == 3000


def test_automaton_has_every_factor_once():
    w = [1, 2, 1, 2, 3, 1, 2, 1]
    longest, link, _ = suffix_automaton(w)
    factors = {tuple(w[i:j]) for i in range(len(w)) for j in range(i + 1, len(w) + 1)}
    assert sum(longest[v] - longest[link[v]] for v in range(1, len(longest))) == len(factors)


@pytest.mark.parametrize(("least", "times"), [(24, 3), (6, 2), (9, 3), (12, 4), (2, 2)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least * times)
    for _ in range(150):
        w = loopy(rng)
        assert runs_in(w, least, times) == brute_runs(w, least, times)
        docs = [loopy(rng, 30), w, [], w]
        flat, owner = np.array(sum(docs, []), np.int64), np.repeat(np.arange(4), list(map(len, docs)))
        got = []
        for a, b in stretches(flat, owner, least, times):
            base = sum(map(len, docs[: owner[a]]))
            assert owner[a] == owner[b - 1]
            got += [(int(owner[a]), a - base + s, n, q) for s, n, q in runs_in(flat[a:b].tolist(), least, times)]
        assert sorted(got) == [(o, *r) for o, d in enumerate(docs) for r in brute_runs(d, least, times)]


def test_long_loops_take_linear_time():
    assert runs_in([7] * 100_000) == [(0, 100_000, 1)]
    assert runs_in([i % 1000 for i in range(50_000)]) == [(0, 50_000, 1000)]


def test_run_digests(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(map(str, loopy(rng)))) for i in range(150)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (500, None), (501, ""), (502, " \t\n\x0b\x0c\r"), (503, "a a " * 30), (504, "x " * 5000), (-7, "b c " * 40)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, runs string")
    got = sorted([tuple(r) for r in run_digests(df).collect()], key=repr)
    want = []
    for i, t in rows:
        w = (t or "").encode().split()
        n, h = len(w), zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and n:
            g, a = h // 10, (h // 10) % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(n)]
        assert planted(i, (t or "").encode().split()) == w
        runs = brute_runs(w, 24, 3)
        gone = {k for s, size, q in runs for k in range(s + q, s + size)}
        best = max(runs, key=lambda r: (r[1] * 10**9 // r[2], -r[0], -r[2]), default=None)
        row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *row, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    assert got == sorted(want, key=repr)
    assert run_digests(df.limit(0)).collect() == []


def test_runs_are_told_with_the_text_that_stays(spark):
    df = spark.createDataFrame([(1, "start " + "one two three " * 10 + "end")], "doc_id long, text string")
    row = word_runs(df).first()
    assert [tuple(r) for r in row.runs] == [(1, 30, 3)] and row.collapsed == "start one two three end" and row.n_words == 32
    with pytest.raises(ValueError, match="two periods"):
        word_runs(df, exponent=1)


# suffix trees


def brute_windows(rows, length):
    docs, first = [(i, (t or "").encode().split()) for i, t in rows], {}
    for i, w in docs:
        for s in range(len(w) - length + 1):
            if i is not None:
                first[tuple(w[s : s + length])] = min(first.get(tuple(w[s : s + length]), i), i)
    out = []
    for i, w in docs:
        gone = {k for s in range(len(w) - length + 1) if i is not None and first[tuple(w[s : s + length])] < i for k in range(s, s + length)}
        out.append((i, len(w), len(gone), sha(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out, key=repr)


def passages(rng, length):
    some = lambda n, a: [str(rng.randrange(a)) for _ in range(n)]
    pool, rows = [some(rng.randint(length, 3 * length), 30) for _ in range(6)], []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += rng.choice([some(rng.randint(1, length), 1000), rng.choice(pool), rng.choice(pool)[: length + 2], some(rng.randint(1, 2 * length), 2)])
        rows.append((i if i % 13 else None, " ".join(w)))
    return [*rows, (100, rows[3][1]), (101, rows[3][1]), (101, rows[5][1]), (101, rows[5][1]), (7, None), (8, ""), (200, rows[9][1].replace(" ", "\n\t")), (5, rows[20][1])]


@pytest.mark.parametrize(("length", "group"), [(6, 20_000), (6, 3), (50, 20_000), (50, 2), (2, 5)])
def test_repeats_equal_brute_force(spark, length, group):
    """Small groups force longer prefixes and windows told one by one."""
    rows = passages(random.Random(length + group), length)
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, grams int").repartition(5)
    got = [(r.doc_id, r.n_words, sum(x.stop - x.start for x in r.removed), sha(r.kept)) for r in repeats_removed(df, length=length, group_places=group).collect()]
    want = brute_windows(rows, length)
    assert sorted(got, key=repr) == want and sum(r[2] for r in want) > 100


def test_substring_report(spark):
    rng = random.Random(4)
    rows = passages(rng, 50)
    long = " ".join(str(rng.randrange(500)) for _ in range(60_000))
    rows += [(900, long), (901, "new words " + long[200_000:] + " at the end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([tuple(r) for r in substring_report(df).collect()], key=repr) == brute_windows(rows, 50)
    assert substring_report(df.limit(0)).collect() == []


def test_deep_nodes_are_the_maximal_repeats():
    rng = random.Random(8)
    for _ in range(60):
        texts = [[rng.randrange(3) for _ in range(rng.randint(1, 25))] for _ in range(3)]
        want = {}
        for t, w in enumerate(texts):
            for i in range(len(w)):
                for j in range(i + 3, len(w) + 1):
                    want.setdefault(tuple(w[i:j]), []).append((t, i))
        left = lambda p: {(texts[t][i - 1] if i else (t, "start")) for t, i in p}
        right = lambda k, p: {(texts[t][i + len(k)] if i + len(k) < len(texts[t]) else (t, "end")) for t, i in p}
        want = {" ".join(map(str, k)).encode(): sorted(p) for k, p in want.items() if len(p) > 1 and len(left(p)) > 1 and len(right(k, p)) > 1}
        assert dict(maximal_repeats([" ".join(map(str, w)).encode() for w in texts], 3)) == want


def test_subtrees_by_windows_and_by_nodes_agree():
    words = np.array([1, 2, 3, 4, 1, 2, 3, 5, 1, 2, 3, 4])
    string = np.array([0] * 8 + [1] * 4)
    starts = np.array([0, 1, 4, 5, 8, 9])
    by = [Subtree(words, string, starts, 3, nodes=n) for n in (True, False)]
    groups = [{frozenset(t.order[t.top == k].tolist()) for k in set(t.top.tolist()) - {-1}} for t in by]
    assert groups[0] == groups[1] == {frozenset({0, 2, 4}), frozenset({1, 5})}


# prefix tries


def brute_trie(convs):
    nodes, out = {}, []
    for c, path in convs.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    for key, members in nodes.items():
        below = [x for x in nodes if x[: len(key)] == key]
        leaves = [x for x in below if not any(len(y) > len(x) and y[: len(x)] == x for y in below)]
        saved = sum((len(nodes[x]) - 1) * len(x[-1][1]) for x in below if x)
        ends = ",".join(map(str, sorted(c for c in members if len(convs[c]) == len(key))))
        out.append((min(members), len(key), min(nodes[key[:-1]]) if key else None, len(members), sum(len(x) == len(key) + 1 for x in below), len(leaves), saved, sha(ends)))
    return sorted(out, key=repr)


def talks(seed):
    rng, rows = random.Random(seed), []
    for c in [-150, -100, -1, *range(60), *range(195, 320), 10_001, 10_002]:
        if c != 200:  # conversations 201 to 299 have no first one to begin with
            rows += [(c, t or None, rng.choice(["u", "a", None]), rng.choice(["x", "yy", None, "z\U0001f600"])) for t in range(rng.randint(1, 6))]
    return rows


def grouped(rows):
    convs = {}
    for c, t, role, text in rows:
        convs.setdefault(c, []).append((-1 if t is None else t, (role or "", text or "")))
    return {c: [x for _, x in sorted(turns, key=lambda x: x[0])] for c, turns in convs.items()}


@pytest.mark.parametrize("limit", [3, 40, 100_000])
def test_tries_equal_brute_force(spark, limit):
    """Small limits split subtries by their second, third.. turn."""
    rows = talks(limit)
    df = spark.createDataFrame([(*r, 5) for r in rows] + [(None, 1, "u", "x", 5)], "conv_id long, turn long, role string, text string, n int").repartition(5)
    plain = grouped(rows)
    assert sorted([tuple(r) for r in prefix_trie(conversation_turns(df), limit, few=1).collect()], key=repr) == brute_trie(plain)
    again = {}
    for c, path in plain.items():
        h, lead = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        again[c] = plain.get(lead, [])[:h] + path[h:]
    assert any(not path for path in again.values())
    assert sorted([tuple(r) for r in prefix_trie(rebuilt(conversation_turns(df)), limit, few=1).collect()], key=repr) == brute_trie(again)


def test_many_members_end_in_one_node(spark):
    """Ends go by chunks of ids; long and repeated turns, turns of one number."""
    df = spark.range(9000).selectExpr("id - 300 AS conv_id", "explode(array(1, 1, 2)) AS turn", "'u' AS role", "'same' AS text")
    deep = spark.range(3000).selectExpr("20000L AS conv_id", "id AS turn", "'u' AS role", "'deep' AS text")
    nodes = prefix_trie(conversation_turns(df.unionByName(deep))).collect()
    assert len(nodes) == 3004 and max(r.depth for r in nodes) == 3000
    assert [(r.n_convs, r.n_children, r.n_leaves) for r in nodes if r.depth == 0] == [(9001, 2, 2)]
    same = [r for r in prefix_trie(conversation_turns(df)).collect() if r.depth == 3]
    assert [r.ends_sha256 for r in same] == [sha(",".join(str(i) for i in range(-300, 8700)))]


def test_no_conversations(spark):
    df = spark.createDataFrame([(None, 1, "u", "x")], "conv_id long, turn long, role string, text string")
    assert rebuilt_trie(df).collect() == [] and rebuilt_trie(df.limit(0)).collect() == []
