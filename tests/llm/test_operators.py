"""Each operator against brute force, an exact round trip or held-out labels."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import brute
import brute_weighting
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tablecare.llm import covertree, dac, minhash, packing, quality, rules, suffixes, toxicity, transducer, weighting
from tablecare.llm.labelled import labelled
from tablecare.llm.links import components
from tablecare.llm.tokens import Encoder


def made_texts(n: int, seed: int = 3) -> list[str | None]:
    """Texts with copies, near copies, shared passages, repeated words, nulls and empties."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéo") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    out: list[str | None] = []
    for i in range(n):
        kind = rng.randrange(8)
        old = [x for x in out if x]
        if kind == 0 and old:
            out.append(rng.choice(old))
        elif kind == 1 and old:
            parts = rng.choice(old).split(" ")
            for _ in range(rng.randrange(1, 4)):
                parts[rng.randrange(len(parts))] = rng.choice(words)
            out.append(" ".join(parts))
        elif kind == 2 and old:
            out.append(" ".join(rng.choices(words, k=20)) + " " + rng.choice(old)[: rng.randrange(400)])
        elif kind == 3:
            out.append(" ".join([rng.choice(words)] * rng.randrange(1, 60)))
        elif kind == 4:
            out.append(rng.choice([None, "", "  \n", "one", "Two words", "One"]))
        else:
            out.append(" ".join(rng.choices(words, k=rng.randrange(3, 120))) + rng.choice(["", ".\n", "\nA  b"]))
    return out


@pytest.fixture(scope="module")
def docs():
    return list(enumerate(made_texts(150)))


@pytest.fixture(scope="module")
def table(spark, docs):
    return spark.createDataFrame([(i, t, i) for i, t in docs], "doc_id long, text string, node long").repartition(4).cache()


def by_id(df, columns, key="doc_id"):
    return {r[key]: tuple(r[c] for c in columns) for r in df.collect()}


def test_near_duplicate_texts(table, docs):
    got = by_id(minhash.near_duplicates(table), ["n_shingles", "component_id", "kept"])
    assert got == brute.near_duplicates(docs)
    # sketches smaller than the sets
    assert by_id(minhash.near_duplicates(table, k=48), ["n_shingles", "component_id", "kept"]) == got


def test_shared_least_is_never_more_than_what_linked_texts_share():
    rng = np.random.default_rng(1)
    for n in (40, 300, 2000):
        for _ in range(20):
            x = rng.choice(1 << 30, n, replace=False)
            y = np.concatenate([x[: int(n * 6 / 7) + 1], rng.choice(np.arange(1 << 30, 1 << 31), n - int(n * 6 / 7) - 1, replace=False)])
            a, b = (set(np.sort(minhash.sums.__globals__["np"].asarray([hash((int(v), 7)) & 0xFFFFFFFF for v in s]))[:256].tolist()) for s in (x, y))
            assert len(a & b) >= minhash.shared_least(np.array([n]), 256, 75)[0]


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (159, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in [*range(100, 160), 300]}


def test_near_vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(6, 8))
    x = np.concatenate([base[rng.integers(0, 6, 150)] + rng.normal(size=(150, 8)) * rng.choice([0.01, 0.1, 0.3, 0.5], (150, 1)), rng.normal(size=(50, 8))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [None, 1.0]), (904, [1.0]), (905, []), (906, [float("inf")] * 8)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, root int").repartition(3)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = (unit @ unit.T) >= 0.9
    root = brute.classes(list(range(200)), lambda a, b: near[a, b])
    want = {i: (int(near[i].sum()) - 1, root[i], root[i] == i) for i in range(200)} | {i: (0, i, True) for i, _ in rows[200:]}
    for cell in (2048, 40):
        assert by_id(covertree.near_duplicates(df, cell=cell), ["n_links", "component_id", "kept"], "vec_id") == want


def test_codes_are_addressed_directly():
    rng = np.random.default_rng(1)
    for n in (0, 1, 511, 512, 513, 5000):
        ids = rng.choice([3, 200, 300, 50_000, 1 << 20, 2**32 - 1], n).astype(np.uint32)
        codes = dac.Codes(dac.encode(ids, np.array([0, n // 2, n])))
        assert [codes[i] for i in range(n)] == ids.tolist()
        for a, b in np.sort(rng.integers(0, n + 1, (30, 2)), axis=1):
            assert (codes.slice(a, b) == ids[a:b]).all()
        with pytest.raises(IndexError):
            codes[n]


@pytest.mark.parametrize("file", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_tokens_are_those_of_whole_texts(file):
    encoder = Encoder(public_tokenizers.path(file))
    rng = random.Random(1)
    odd = ["a b\0 c \0 d", "", " ", "a ", "a  b", "a\n b", "\n", "a \x1c b", "é é ́x", "don't I'll", "a\t b", "<|endoftext|> a", "Ω Σ ß", "It's dogs' x_y", "ŉa Éa,b éÀ!? ²a a² ªx İi ı"]
    odd += ["".join(rng.choice(["a", "B", " ", "  ", "\n", "　", ".", "'s", "1", "é", "́", "\x1c"]) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]
    assert encoder.encode(odd) == encoder.raw(odd)
    assert encoder.encode(odd) == encoder.raw(odd)  # from memory


def test_token_files(table, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer, at, want = Tokenizer.from_file(path), 0, {}
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert by_id(dac.token_rows(table, path), ["start", "n_tokens", "ids_crc32"]) == want


def test_packing(table, docs):
    path, size = public_tokenizers.path("word_bpe_49k.json"), 64
    tokenizer, want, total = Tokenizer.from_file(path), {}, 0
    for i, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want |= {(i, k): (k * size, len(x), zlib.crc32(x.tobytes())) for k in range(-(-len(ids) // size)) for x in [ids[k * size : (k + 1) * size]]}
    rows = packing.pack(table, path, size=size).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    held = collections.defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    assert len(held) <= -(-total // size) * 1.02 + 1


@pytest.mark.parametrize("n", [1, 50, 20_000])
def test_plan_places_every_piece(n):
    counts = np.bincount(np.clip(np.random.default_rng(n).lognormal(5, 1.2, n).astype(int), 1, 2048), minlength=2049)
    made, used = packing.plan(counts), np.zeros(2049, int)
    for repeats, held in made:
        assert sum(a * b for a, b in held) <= 2048
        for length, times in held:
            used[length] += repeats * times
    assert (used == counts).all()


def test_positive_unlabelled_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    rows = [r for r in quality.scored(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert rows and sum(r["predicted"] == truth[r["doc_id"]] for r in rows) >= 0.93 * len(rows)
    good = [r for r in rows if truth[r["doc_id"]] == 1]
    assert sum(r["predicted"] for r in good) >= 0.97 * len(good)
    # labels of the held fold are never learned from
    assert labelled(labels, "quality", 4, 2).filter("crc32(cast(doc_id as string)) % 4 = 2").count() == 0


def test_class_prior():
    rng = np.random.default_rng(0)
    positive, negative = rng.normal(2, 1, 5000), rng.normal(-2, 1, 2000)
    assert abs(quality.class_prior(positive[:2000], np.concatenate([positive[2000:], negative])) - 0.6) < 0.05


def test_toxicity(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = [r for r in toxicity.scored(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in rows) >= 0.95 * len(rows)
    assert sum(r["predicted"] and not truth[r["doc_id"]] for r in rows) <= 0.01 * len(rows)


def test_segments():
    rng = random.Random(2)
    for _ in range(300):
        places = sorted(rng.sample(range(30), rng.randrange(0, 12)))
        scores = [rng.choice([0.5, 1.25, 2.0, 3.5]) for _ in places]
        line = [-0.75] * 30
        for p, s in zip(places, scores):
            line[p] = s
        got = sorted((round(s, 6), a, b) for s, a, b in toxicity.segments(places, scores, -0.75))
        want = sorted((round(s, 6), a, b) for s, a, b in brute.segments(line))
        assert sum(s for s, _, _ in got) == pytest.approx(sum(s for s, _, _ in want)) and len(got) == len(want)


def test_rule_counts_and_thresholds(spark):
    rng = random.Random(5)
    texts = made_texts(120, 5) + ["a b c d e a b c d e", "x\nx\n\nx \n", "# $ |", "é" * 5]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s1", None])) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    word = re.compile(r"[^\x20\x09-\x0d]+")
    for i, t, *_ in rows:
        w, seen, dup = word.findall(t or ""), set(), 0
        for line in (t or "").split("\n"):
            if word.search(line):
                dup += line in seen
                seen.add(line)
        many = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        repeats = len({p for k in range(len(w) - 4) if many[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)})
        want = (len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), dup, repeats)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
        assert got[i]["base_failed"] == (len(w) < 10 or 100 * repeats > 20 * len(w)) and not (got[i]["kept"] and got[i]["base_failed"])


def test_rule_thresholds_follow_the_group(spark):
    def text(name: object, mark: str) -> str:
        return " ".join(f"{name}x{k}{mark}" for k in range(30))

    rows = [(i, text(i, ""), "en", "news") for i in range(250)] + [(1000 + i, text(i, "$"), "en", "shop") for i in range(250)]
    rows += [(9001, text("odd", "$"), "en", "news"), (9002, text("even", "$"), "en", "shop")]
    got = by_id(rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), ["kept", "base_failed"])
    assert got[9001] == (False, False) and got[9002] == got[5] == got[1005] == (True, False)


def test_context_tree(spark):
    texts = ["the cat sat", "the cat ran é", "", "THE dog sat on the cat", None, "aaaa bbbb aaaa", "x" * 300] * 4
    docs = [*enumerate(texts), (None, "the cat")]
    train = [brute.lower(t) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10]
    cost = brute_weighting.model(train, weighting.DEPTH)
    count = collections.Counter(w for t in train for w in [*brute.WORD.findall(t), None])
    total, kinds = sum(count.values()), len(count)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    order = lambda i: (i is None, i or 0)
    for block, bucket in ((1 << 25, 1 << 23), (3000, 500)):
        got = sorted(weighting.scored(df, block_bytes=block, bucket_bytes=bucket).collect(), key=lambda r: order(r["doc_id"]))
        assert len(got) == len(docs)
        for row, (_, text) in zip(got, sorted(docs, key=lambda d: order(d[0]))):
            raw = b"\0" * weighting.DEPTH + brute.lower(text) + b"\0"
            words = [*brute.WORD.findall(brute.lower(text)), None]
            assert row["score"] == pytest.approx(sum(cost(raw[i - weighting.DEPTH : i], raw[i]) for i in range(weighting.DEPTH, len(raw))))
            assert row["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words))
            assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (len(words), sum(count[w] > 0 for w in words), total)


def test_pieces_are_the_library_s(spark, table, docs):
    from sentencepiece import SentencePieceProcessor

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    odd = ["", " ", "  ", "a  b", " a ", "\n\n  x", "日本é☃\t", "a" * 40, " " * 27, "\0", "😀 ok", "1234567890"]
    odd += ["".join(rng.choice("abc .,é日☃ \n1!'-_") for _ in range(rng.randrange(1, 30))) for _ in range(1000)]
    own = transducer.Transducer(path)
    for text in odd:
        ids = np.frombuffer(own.encode(text), "<u4").tolist()
        assert ids == library.encode(text) and own.decode(ids) == text
    encoded = transducer.encoded(table, path)
    assert {r["doc_id"]: r["ids"] for r in encoded.collect()} == {i: library.encode(t or "") for i, t in docs}
    assert by_id(transducer.decoded(encoded, path), ["text"]) == {i: (t or "",) for i, t in docs}
    assert all(r["same"] for r in transducer.round_trip(table, path).collect())


def test_repeated_strings(spark, table, docs):
    columns = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert by_id(suffixes.without_repeats(table), columns) == brute.without_repeats(docs)
    rng = random.Random(4)
    small: list[tuple] = []
    for i in range(80):
        parts = []
        for _ in range(rng.randrange(6)):
            old = rng.choice(small)[1] if small else ""
            a = rng.randrange(len(old) + 1)
            parts.append(rng.choice(["ab" * rng.randrange(1, 120), old[a : a + rng.randrange(50, 400)], "é x " * rng.randrange(1, 80), "".join(rng.choices("abcdefgh ", k=rng.randrange(1, 300)))]))
        small.append((i, "".join(parts)))
    df = spark.createDataFrame(small, "doc_id long, text string").repartition(5)
    assert by_id(suffixes.without_repeats(df), columns) == brute.without_repeats(small)


def test_a_long_text_is_handled_in_slices(spark, monkeypatch):
    line = "".join(random.Random(1).choices("abcdef ", k=3000))
    docs = [(0, line + "x" + line[:1500]), (1, "y" + line[200:])]
    monkeypatch.setattr(suffixes, "SLICE", 700)
    assert by_id(suffixes.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")), ["n_bytes", "n_removed", "n_spans", "kept_sha256"]) == brute.without_repeats(docs)
