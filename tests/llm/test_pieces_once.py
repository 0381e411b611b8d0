"""A step's pieces are looked up once each, and texts with odd white space have the library's ids."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest

from tablecare.llm.tokens import Encoder


class Counted(dict):
    asked = 0

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_pieces_are_looked_up_once_a_step():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    encoder.known = known = Counted()
    encoder.encode(["one two two two three " * 300 + "end"] * 20)
    assert known.asked <= 8


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_white_space_of_all_kinds(name):
    encoder = Encoder(public_tokenizers.path(name))
    chance = random.Random(3)
    parts = [" ", "  ", "\n", "\t", "\xa0", " ", "　", "\x1c", "\x85", " ", "\r\n", "word", "Wörter", "x1", "...", "(so)", "\U0001f600", "漢字"]
    texts = ["", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\xa0 b", "a  b", "a\x85 b", "a \x1cb"]
    texts += ["".join(chance.choices(parts, k=chance.randrange(1, 30))) for _ in range(400)]
    texts += [" ".join(chance.choices(parts[11:], k=20)) for _ in range(100)]
    for step in ([], texts, texts[:1], texts[20:40], texts[-5:]):
        wanted = encoder.tokenizer.encode_batch(step, add_special_tokens=False)
        assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(step)] == [x.ids for x in wanted]
