"""The segment encoder against the untouched tokenizer on mixes of white space."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from strandweave.llm import segment_encoder  # noqa: E402

WHITE = [" "] * 4 + ["\n"] * 2 + list("\t\r\v\f\x1c\x1d\x1e\x1f\x85\xa0      　​")


def test_white_space_mixes_equal_the_untouched_tokenizer():
    encoder = segment_encoder.SegmentEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(3)
    signs = [*"ab'é1.,日", "word", "'s", "it's", *WHITE]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(50_000)]
    texts += ["a\tb  c", "word\tword2  end of it", "x\xa0y  z", "a\tb \nc", "'s\x1cword é\n\xa0", " ", "\n", ""]
    assert [t for t, got in zip(texts, encoder.encode(texts)) if got != encoder.whole(t)] == []


def test_plain_takes_single_spaces_and_newlines_only():
    plain = segment_encoder.SegmentEncoder.plain
    assert plain("a b\nc") and plain("a")
    assert not any(map(plain, ["a\tb  c", "a  b", " a", "a ", "a \nb", "a\tb", "a\xa0b", "a\x1cb"]))
