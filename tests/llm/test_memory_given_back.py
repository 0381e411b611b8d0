"""Tasks hand free memory back at their end, and the pipeline's workers drop the encoder once all is encoded."""

from __future__ import annotations

import pyarrow as pa
import pytest

from tablecare.llm import text, tokens


def test_a_task_hands_memory_back_at_its_end(monkeypatch):
    told = []
    monkeypatch.setattr(text, "give_back", lambda: told.append(1))
    batches = [pa.RecordBatch.from_pydict({"a": [i]}) for i in range(3)]
    work = text.tidied(lambda given: (b for b in given))(iter(batches))
    assert next(work).equals(batches[0]) and not told
    assert [b.column(0)[0].as_py() for b in work] == [1, 2] and told == [1]


def test_a_task_that_fails_hands_memory_back(monkeypatch):
    told = []
    monkeypatch.setattr(text, "give_back", lambda: told.append(1))

    def run(given):
        yield next(given)
        raise ValueError("no more")

    with pytest.raises(ValueError, match="no more"):
        list(text.tidied(run)(iter([pa.RecordBatch.from_pydict({"a": [1]})])))
    assert told == [1]


def test_encoders_are_dropped(monkeypatch):
    monkeypatch.setattr(tokens, "_encoders", {"somewhere": object()})
    tokens.forget()
    assert tokens._encoders == {}


def test_memory_is_handed_back():
    text.give_back()  # on any system
