"""Short lists merged by a heap, by sorting and by counting give the same."""

import numpy as np
import pytest

from quillspark.llm import ngram_join


@pytest.mark.parametrize("universe", [50, 400])
def test_ways_to_merge_short_lists_agree(monkeypatch, universe):
    rng = np.random.default_rng(universe)
    sets = sorted((np.unique(rng.integers(0, universe, rng.integers(1, 12))).astype(np.uint64) for _ in range(300)), key=len)
    search = ngram_join.DivideSkip(sets, 80, 100)
    ways = set()
    for _ in range(200):
        short = rng.choice(len(search.lengths), rng.integers(1, 8), replace=False)
        low, high = sorted(rng.integers(0, len(sets) + 1, 2).tolist())
        least = int(rng.integers(1, 4))
        held = [search.lists[search.ends[t] - search.lengths[t] : search.ends[t]] for t in short.tolist()]
        ways.add(sum(((x >= low) & (x < high)).sum() for x in held) * 8 < high - low)
        want = sorted((int(sum(d in x for x in held)), d) for d in range(low, high))
        want = {d: n for n, d in want if n >= least}
        for most in (0, 1 << 30):
            monkeypatch.setattr(ngram_join, "HEAP_POSTINGS", most)
            docs, counts = search.merge_short(short, low, high, least)
            assert dict(zip(docs.tolist(), counts.tolist(), strict=True)) == want
            assert (np.diff(counts) <= 0).all()
    assert universe == 50 or ways == {True, False}
