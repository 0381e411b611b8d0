"""Words of ASCII letters with punctuation after them, most pieces, go to the memory of words without the expression."""

from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from tablecare.llm import tokens


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_most_pieces_need_no_expression(file, monkeypatch):
    own = tokens.Encoder(public_tokenizers.path(file))
    texts = ["So one two, three. Four### five!? six%%%", "x don't (so) a1 é, Été. end.\nThen ... ''", "w A. b; one two,"]
    whole = [np.array(own.tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() for x in texts]
    assert own.encode(texts) == whole

    class Asked:
        pieces: list[str] = []

        def fullmatch(self, piece):
            self.pieces.append(piece)
            return expression.fullmatch(piece)

    expression = tokens._WORD
    monkeypatch.setattr(tokens, "_WORD", Asked())
    own = tokens.Encoder(public_tokenizers.path(file))
    assert own.encode(texts) == whole
    assert sorted(Asked.pieces) == sorted(["don't", "(so)", "a1", "é,", "Été.", "end.\nThen", "...", "''"])
    Asked.pieces.clear()


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_few_remembered_pieces(file):
    own = tokens.Encoder(public_tokenizers.path(file), most=2)
    for text in ["one two three four", "one five two. six", "four (x) one", "a b c d"] * 2:
        assert own.encode([text]) == [np.array(own.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]
        assert len(own.known) <= 2 + 3  # as many as words, and those of a step
