"""Words at the end and start of lines, and words of former steps, are taken from memory."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from tablecare.llm import tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("file", FILES)
def test_words_around_line_ends_are_words(file, monkeypatch):
    own = tokens.Encoder(public_tokenizers.path(file))
    texts = ["one two.\nThree four", "a b\nc d", "x don't.\n's y", "q é.\nÉté!\nZ it'\ns", "w a.\n\nb c.\n d", "v Ab,\r\nc a.\n1", "u a-\n-b"]
    whole = [np.array(own.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert own.encode(texts) == whole
    own = tokens.Encoder(public_tokenizers.path(file))
    monkeypatch.setattr(own, "pieces", lambda new: [] if not new else pytest.fail(f"encoded with the library: {new}"))
    assert own.encode(texts[:2]) == whole[:2]


@pytest.mark.parametrize("file", FILES)
def test_words_asked_for_again_stay(file):
    own = tokens.Encoder(public_tokenizers.path(file), most=3)
    own.learn(["alpha", "beta", "gamma", "delta"])
    own.learn(["alpha"])
    assert own.space + "alpha" in own.stems and own.space + "beta" in own.older
    own.learn(["alpha,", "epsilon", "zeta"])
    own.learn(["eta"])
    assert own.space + "alpha" in own.older and own.space + "beta" not in own.older
