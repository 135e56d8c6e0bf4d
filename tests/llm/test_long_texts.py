"""Long texts without spaces, and patterns other than the usual one."""

import random
import time

import public_tokenizers
import pytest
import regex
import sentencepiece

from quillspark.llm import bpe
from quillspark.llm.token_counts import PieceCounter


@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def test_ideographs_take_linear_time(model):
    rng = random.Random(1)
    pool = [chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(2000)] + list("的是不了在人有我他这") * 100
    text = "".join(rng.choices(pool, k=2_000_000))
    counter, began = PieceCounter(model), time.time()
    n = counter.count(text)
    assert time.time() - began < 20
    assert n == len(sentencepiece.SentencePieceProcessor(model_proto=model).encode(text))


@pytest.mark.parametrize("letters", ["a", "etaoin", "あいうえお", "กขคงจ", "的是 ,", "\U0001f600é"])
def test_counts_without_boundaries(model, letters):
    rng, counter = random.Random(len(letters)), PieceCounter(model, chunk=64, overlap=4)
    plain = sentencepiece.SentencePieceProcessor(model_proto=model)
    for n in (63, 64, 65, 200, 5000):
        text = "".join(rng.choices(letters, k=n))
        assert counter.count(text) == len(plain.encode(text))


def test_spliced_counts_of_mixed_texts(model):
    rng, counter = random.Random(4), PieceCounter(model, chunk=40, overlap=5)
    plain = sentencepiece.SentencePieceProcessor(model_proto=model)
    parts = ["the", "ation", "ing", " ", "  ", "▁", "é", "日本", "語の", "\U0001f642", "x", "\n", "0", "12", "ﬁ", "ａ", "​", "."]
    for _ in range(800):
        text = "".join(rng.choices(parts, k=rng.randint(0, 150)))
        assert counter.count(text) == len(plain.encode(text))


@pytest.mark.parametrize("pattern", [r"\S+|\s+", r"\p{L}+|\p{N}{1,3}|[^\p{L}\p{N}]+", public_tokenizers.PATTERN])
def test_any_pattern_is_obeyed(pattern):
    replay, rng = bpe.Replay([bytes([i]) for i in range(256)], pattern), random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(["ab", "'s", " ", "  ", "\n", "1234", "é", "\xa0", "!", "日", "x"], k=rng.randint(0, 20)))
        assert replay.split(text) == regex.findall(pattern, text)
