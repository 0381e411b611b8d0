"""Token ids of whole texts by a public tokenizer, through a cache of the pieces between single spaces.

The tokenizers used here never join characters over a space that stands alone between two other characters, so a text's
ids are those of its pieces, each with the space before it. Pieces repeat far more often than texts. Where a text holds
the content of an added token (``<|endoftext|>``), the library makes it that one token and encodes what stands before and
after it apart; so is it here. Tests compare the ids with those of whole texts.
"""

from __future__ import annotations

import os
import re
import struct
from string import punctuation

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of a worker's memory, as many as its words at most; what it forgets is encoded again.
REMEMBERED = 250_000
#: Words of a worker's memory; as many that were not asked for again may stay beside them.
STEMS = 700_000

#: A character that ends a piece when many are encoded together.
MARK = "\0"
AT_ONCE = 20_000

#: Pieces that are Latin letters and then punctuation, twice if a line ends between: always tokens apart, so letters are encoded once for all.
_LETTERS, _MARKS = "A-Za-zÀ-ÖØ-öø-įıĲ-ſ", r"[!-/:-@\[-`{-~]*"
_WORD = re.compile(rf"([{_LETTERS}]+)({_MARKS})(?:\n([{_LETTERS}]+)({_MARKS}))?")
_ALONE = re.compile(r"(?<=\S) (?=\S)")
#: White space, for Arrow's expressions, and texts where a space does not stand alone or white space is at an end.
_WHITE = r"[\t-\r\x1c-\x20\x{85}\pZ]"
_LOOSE = rf"\A{_WHITE}|{_WHITE}\z| {_WHITE}|{_WHITE} |\A\z"
#: Byte-level tokenizers show bytes as characters: printable ones of Latin-1 as themselves, the others from U+0100 on.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_SHOWN = {b: chr(b) for b in _PLAIN} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in set(_PLAIN))}
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str, most: int = STEMS):
        self.most = most
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content: struct.pack("<I", i) for i, t in added.items()}
        self.at_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) or r"(?!)")
        if any(t.normalized or t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError(f"{path}: added tokens that look beyond their own content are not supported")
        self.known: dict[str, bytes] = {}
        self.stems: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        shown = self.tokenizer.pre_tokenizer.pre_tokenize_str(" a")
        self.space = shown[0][0][:-1]  # how a space before a word shows in its token, if it does
        normal = self.tokenizer.normalizer
        self.lower = normal is not None and normal.normalize_str("A") == "a"
        between = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal.normalize_str("a\nb") if normal else "a\nb")
        shows = "".join(x for x, _ in between)[1:-1]  # how the end of a line between letters shows, if it does
        self.line = np.array([x.id for x in self.tokenizer.model.tokenize(shows)] if shows else [], "<u4").tobytes()
        self.mark = np.array(self.tokenizer.encode(f" {MARK}", add_special_tokens=False).ids, "<u4")

    def pieces(self, new: list[str]) -> list[bytes]:
        """Ids of pieces that hold no mark themselves: many are encoded as one text, with the mark after each."""
        found = []
        for i in range(0, len(new), AT_ONCE):
            some = new[i : i + AT_ONCE]
            joined = self.tokenizer.encode_batch_fast(["".join(f" {x} {MARK}" for x in some)], add_special_tokens=False)
            ids = np.array(joined[0].ids, "<u4")
            ends = np.flatnonzero(ids == self.mark[-1]) + 1
            raw, starts = ids.tobytes(), 4 * np.concatenate([[0], ends[:-1]])
            found += [raw[a:b] for a, b in zip(starts.tolist(), (4 * (ends - len(self.mark))).tolist())]
        return found

    def stem(self, text: str, before: str) -> bytes:
        """Ids of letters, or of punctuation, that are a word of the tokenizer by themselves."""
        key = before + text
        known = self.stems.get(key)
        if known is None:
            known = self.older.get(key)
            if known is None:
                found = [x.id for x in self.tokenize(key if text.isascii() else before + "".join(map(_SHOWN.__getitem__, text.encode())))]
                known = struct.pack(f"<{len(found)}I", *found)
            self.stems[key] = known
        return known

    def learn(self, new: list[str]) -> None:
        if len(self.stems) > self.most:  # those asked for since then move over again
            self.older, self.stems = self.stems, {}
        known, stems, space, rest = self.known, self.stems, self.space, []
        for piece in new:
            letters = piece.rstrip(punctuation)
            if letters.isascii() and letters.isalpha():  # most pieces; without the expression
                marks, more = piece[len(letters) :], None
            else:
                found = _WORD.fullmatch(piece)
                if not found:
                    rest.append(piece)
                    continue
                letters, marks, more, last = found.groups()
            if self.lower:
                letters = letters.lower()
            ids = stems.get(space + letters) or self.stem(letters, space)
            if marks:
                ids += stems.get(marks) or self.stem(marks, "")
            if more:
                ids += self.line + self.stem(more.lower() if self.lower else more, "")
                if last:
                    ids += self.stem(last, "")
            known[piece] = ids
        alone = [x for x in rest if MARK in x or x[-1].isspace()]  # a text can end in white space
        if alone:
            rest = list(set(rest).difference(alone))
            known.update(zip(alone, self.raw([" " + x for x in alone])))
        known.update(zip(rest, self.pieces(rest)))

    def raw(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, of those with added tokens as the ids of the texts between them."""
        held = {i: text for i, text in enumerate(texts) if any(x in text for x in self.added)}
        if not held:
            return self.plain(texts)
        between = {i: self.at_added.split(text) for i, text in held.items()}
        parts = iter(self.plain([part for i, text in enumerate(texts) for part in between.get(i, [text])]))
        out = []
        for i, text in enumerate(texts):
            ids = [next(parts)]
            for token in self.at_added.findall(text) if i in held else ():
                ids += [self.added[token], next(parts)]
            out.append(b"".join(ids))
        return out

    def plain(self, texts: list[str]) -> list[bytes]:
        """Ids of texts without added tokens: each distinct piece is looked up once, its ids are copied to all its places."""
        if not texts:
            return []
        if len(self.known) > min(REMEMBERED, self.most):  # most are made again of words that are still known
            self.known = {}
        column = pa.array(texts, pa.large_string())
        cut, order = pc.split_pattern(column, " "), np.arange(len(texts))
        # a piece that is empty or touches more white space isn't apart from its neighbours
        loose = pc.match_substring_regex(column, _LOOSE)
        if loose.true_count:
            again = [_ALONE.split(text) for text in column.filter(loose).to_pylist()]
            cut = pa.concat_arrays([cut.filter(pc.invert(loose)), pa.array(again, cut.type)])
            order = np.argsort(loose.to_numpy(zero_copy_only=False), kind="stable")
        offs = cut.offsets.to_numpy()
        coded = cut.flatten().dictionary_encode()
        words, at = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        first = np.zeros(len(at), bool)
        first[offs[:-1]] = True
        asked = np.flatnonzero(np.bincount(at[~first], minlength=len(words)))
        names = words[asked].tolist()
        ids = list(map(self.known.get, names))
        missing = [i for i, x in enumerate(ids) if x is None]
        if missing:
            new = [names[i] for i in missing]
            self.learn(new)
            for i, piece in zip(missing, new):
                ids[i] = self.known[piece]
        ids += self.raw(words[at[first]].tolist())
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        which = np.zeros(max(len(words), 1), np.int32)
        which[asked] = np.arange(len(asked))
        which = which[at]
        which[first] = len(asked) + np.arange(len(texts))
        many = n[which]
        ends = np.cumsum(many)
        # narrow places are copied in half the time
        kind = np.int32 if max(ends[-1], n.sum()) < 2**31 else np.int64
        places = np.repeat(((np.cumsum(n) - n)[which] - (ends - many)).astype(kind), many)
        places += np.arange(len(places), dtype=kind)
        raw = np.frombuffer(b"".join(ids), "<u4")[places].tobytes()
        bounds = (4 * np.concatenate([[0], ends])[offs]).tolist()
        out = [b""] * len(texts)
        for i, a, b in zip(order.tolist(), bounds[:-1], bounds[1:]):
            out[i] = raw[a:b]
        return out


def forget() -> None:
    """Drop the worker's encoders, when all is encoded."""
    _encoders.clear()


def encoder(path: str, most: int = STEMS) -> Encoder:
    """The worker's encoder of this file, which remembers ``most`` words."""
    if path not in _encoders:
        _encoders[path] = Encoder(path, most)
    _encoders[path].most = most
    return _encoders[path]
