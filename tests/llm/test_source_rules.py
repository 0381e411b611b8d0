"""Repeats under the fixed cutoff."""

from __future__ import annotations

from tablecare.llm import rules


def test_repeats_under_the_fixed_cutoff_are_judged_by_their_source(spark):
    def plain(name: object) -> list[str]:
        return [f"{name}x{k}" for k in range(100)]

    def again(name: object) -> str:  # 12 of 106 words are in repeated windows
        return " ".join([*plain(name), *plain(name)[:6]])

    rows = [(i, " ".join(plain(i)), "en", "news") for i in range(250)] + [(1000 + i, again(i) if i % 3 == 0 else " ".join(plain(i)), "en", "songs") for i in range(250)]
    rows += [(9001, again("odd"), "en", "news"), (9002, again("odd"), "en", "songs"), (9003, "\n".join(["menu here", *plain("q")[:6], "menu here", *plain("r")[:1], "menu here"]), "en", "news")]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i]["base_failed"] for i in (9001, 9002, 9003))
    assert got[9001]["failed"] == ["repeats"] and not got[9001]["kept"] and got[9002]["kept"]
    assert "dup_lines" in got[9003]["failed"]
