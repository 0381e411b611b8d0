"""Texts that hold the content of added tokens, against the untouched library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablecare.llm.tokens import Encoder


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_added_tokens_are_the_library_s(file):
    path = public_tokenizers.path(file)
    encoder, library = Encoder(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    made = ["a <|endoftext|> b", "<|endoftext|>", "<|startoftext|><|endoftext|>", "<|ENDOFTEXT|> a", "<|endoftext|"]
    made += ["".join(rng.choice(["a", "Bc", " ", "  ", "\n", ".", "'s", "1", "é", "\0", "<|", "<|endoftext|>", "<|startoftext|>", "̸"]) for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(made)] == [library.encode(x, add_special_tokens=False).ids for x in made]
