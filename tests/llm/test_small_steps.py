"""What a task of the near-duplicate search holds at a time."""

from __future__ import annotations

from tablecare.llm import minhash, text


def test_windows_are_made_of_a_megabyte_at_a_time(spark, monkeypatch):
    steps, map_texts = [], minhash.map_texts

    def seen(docs, work, schema, column="text", step=text.STEP_BYTES):
        steps.append(step)
        return map_texts(docs, work, schema, column, step)

    monkeypatch.setattr(minhash, "map_texts", seen)
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")], "doc_id long, text string")
    assert minhash.sketches(docs, "text", ["doc_id"]).count() == 3
    assert steps and max(steps) <= 1 << 20
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 4 << 20
