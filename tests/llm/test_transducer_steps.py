"""The composition tries only arcs that a piece can begin with, and texts of a step share their parts."""

from __future__ import annotations

import public_tokenizers

from tablecare.llm.transducer import Transducer


class Counted(dict):
    asked = 0

    def __contains__(self, key):
        Counted.asked += 1
        return super().__contains__(key)


def test_arcs_end_with_the_beginnings_of_pieces():
    own = Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    own.ids = Counted(own.ids)
    text = "qxqzvwjkqx" * 20
    assert "".join(own.shortest(text)) == text
    assert Counted.asked <= 2 * len(text)  # not one for each length that a piece can have


def test_parts_of_many_texts_are_worked_out_once(monkeypatch):
    own = Transducer(public_tokenizers.path("piece_bpe_32k.model"))
    texts = ["ab cde", "", "cde ab", "日本 ab"]
    want = [own.encode(x) for x in texts]
    own.known.clear()
    done, part = [], own.part
    monkeypatch.setattr(own, "part", lambda x: done.append(x) or part(x))
    assert own.encode_all(texts) == want and len(done) == len(set(done))
