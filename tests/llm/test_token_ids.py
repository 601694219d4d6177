"""Ids of the word path against the tokenizer itself."""

import random
from array import array

import pytest
from tokenizers import Tokenizer

from roadloom.llm.packing import WordIds
from roadloom.llm.queries import tokenizer_path

END = (2).to_bytes(4, "little")
MARKS = "".join(map(chr, range(0x300, 0x346)))
LETTERS = "ABCTWYHJabctwyhj'sSdD<|>.,!09İßéÉﬁ가가KKΩ\x85\xa0　\x1c\x00 \t\n゙ְٕ"


@pytest.fixture(scope="module")
def both():
    return WordIds(tokenizer_path()), Tokenizer.from_file(tokenizer_path())


def expected(tokenizer, text):
    return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes() + END


@pytest.mark.parametrize("text", ["T̈", "W̊", "Y̊", "H̱", "J̌", "Tְ̈", "T̈́", "<|endoftext|>", "A<|ENDOFTEXT|>", "", "don't I'LL 've"])
def test_ids_of_odd_words(both, text):
    assert both[0].encode(text, END) == expected(both[1], text)


def test_ids_of_random_strings(both):
    rng = random.Random(3)
    for _ in range(40_000):
        text = "".join(rng.choices(LETTERS + MARKS[: rng.choice((0, 8, 70))], k=rng.randint(1, 12)))
        assert both[0].encode(text, END) == expected(both[1], text), text


def test_another_tokenizer_encodes_whole_texts(tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    text = "Two  Words,\n\nand T̈ more"
    assert WordIds(path).encode(text, END) == expected(Tokenizer.from_file(path), text)
