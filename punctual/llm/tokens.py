"""Token ids of whole texts by the tokenizers library, each distinct piece of text encoded once.

Texts are cut where no token can cross: before a space between two characters that are not white
space (byte-level vocabularies, whose words carry the space in front of them) or at every space
(vocabularies that drop white space). A task keeps the ids of the pieces it has met, up to a bound, and
forgets them when it ends. A new piece of nothing but letters and marks goes to the library's model part
by part, each part once: that its rules cut such pieces between letters and marks, as here, is tested on
examples.
"""

from __future__ import annotations

import gc
import json
import os
import re
from array import array
from collections import defaultdict
from collections.abc import Callable
from itertools import chain, count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces, and characters in them, that a task remembers before it forgets the rare ones.
MEMO_PIECES, MEMO_CHARS = 400_000, 12_000_000
#: Pieces that are encoded in one call.
JOINED = 512
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: Words of letters and runs of marks (no apostrophe, nor "<", which begins added tokens), single line ends between.
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", r"[!-&(-/:;=-@\[-`{-~]+"
_WORDS = re.compile(f"( ?)({_LETTERS}|{_MARKS})((?:(?<={_LETTERS[:-1]}){_MARKS})?)((?:\n?(?:{_LETTERS}|{_MARKS}))*)")
_PARTS = re.compile(f"{_LETTERS}|{_MARKS}|\n")
_EXAMPLES = ["a", "Zebra", "été", "Ünter", "ÿ", "Øl", "internationalisation", "don", "S", "THSTINNT", "end.\nNext", "(a-b)", "x/y_z", "#\n#", "été!!\nÀ"]


def _byte_letters() -> dict[int, str]:
    """The letters that stand for bytes in byte-level vocabularies: printable ones for themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(plain)))}


_BYTE_LETTERS = _byte_letters()
_SPACE, _LINE_END = _BYTE_LETTERS.pop(32), _BYTE_LETTERS[10]


def _normaliser(tokenizer) -> Callable[[str], str]:
    """The vocabulary's normalizer for words of _LETTERS or _MARKS with spaces between.

    Nothing in them can be composed, and there is no other white space; steps that do not come down to lower
    case or nothing then go through the library.
    """
    if tokenizer.normalizer is None:
        return str
    steps = [json.loads(tokenizer.normalizer.__getstate__())]
    while any(s["type"] == "Sequence" for s in steps):
        steps = [inner for s in steps for inner in (s["normalizers"] if s["type"] == "Sequence" else [s])]
    spaces = {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}
    if all(s["type"] in ("NFC", "Lowercase") or s == spaces for s in steps):
        return str.lower if any(s["type"] == "Lowercase" for s in steps) else str
    return tokenizer.normalizer.normalize_str


class _Known:
    """Ids of the pieces of one memo, one after another."""

    def __init__(self, prefix: str):
        # Pieces are numbered in the order they are first met.
        self.prefix, self.memo = prefix, defaultdict(count().__next__)
        self.bounds, self.ids, self.chars = np.zeros(1, np.int64), np.zeros(0, np.uint32), 0
        self.uses, self.open = np.zeros(0, np.int64), np.zeros(0, bool)

    def open_ends(self) -> np.ndarray:
        """For every piece met so far, whether it has white space at an end."""
        if len(self.open) < len(self.memo):
            # White space at an end of a piece: the space next to it may not be a place to cut.
            new = [not p or p[0].isspace() or p[-1].isspace() for p in islice(self.memo, len(self.open), None)]
            self.open = np.concatenate([self.open, np.array(new, bool)])
        return self.open

    def learn(self, encode) -> None:
        new = [self.prefix + piece for piece in islice(self.memo, len(self.bounds) - 1, None)]
        if not new:
            return
        ids, sizes = encode(new)
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])
        self.chars += sum(map(len, new))

    def used(self, codes: np.ndarray) -> None:
        counts = np.bincount(codes, minlength=len(self.memo))
        counts[: len(self.uses)] += self.uses
        self.uses = counts

    def tidy(self) -> None:
        """Keep the most used pieces, a third of the bounds at most, when either bound is passed."""
        if len(self.memo) <= MEMO_PIECES and self.chars <= MEMO_CHARS:
            return
        order = np.argsort(-self.uses, kind="stable")
        pieces = list(self.memo)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        fits = (np.cumsum(sizes[order]) <= MEMO_CHARS // 3) & (np.arange(len(order)) < MEMO_PIECES // 3)
        kept = np.sort(order[fits & (self.uses[order] > 1)])
        low, size = self.bounds[kept], self.bounds[kept + 1] - self.bounds[kept]
        ends = np.cumsum(size)
        self.ids = self.ids[np.repeat(low - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        self.bounds, self.uses = np.concatenate([[0], ends]).astype(np.int64), self.uses[kept]
        if len(self.open):
            self.open = self.open_ends()[kept]
        self.memo = defaultdict(count(len(kept)).__next__, zip((pieces[old] for old in kept.tolist()), count()))
        self.chars = int(sizes[kept].sum())


class TextEncoder:
    """encode(texts): all ids, and the bounds of each text's ids in them.

    Strings of added tokens are ordinary text, or, unless added_as_text, have the token's one id as the
    library gives by default; a text that holds one is then encoded whole.
    """

    def __init__(self, path: str, keeps_spaces: bool, added_as_text: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = added_as_text
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added and not added_as_text else None
        # With a special token between them many pieces are encoded in one call.
        self.joined = Tokenizer.from_file(path)
        between = [
            (i, t.content)
            for i, t in self.joined.get_added_tokens_decoder().items()
            if t.special and not (t.lstrip or t.rstrip or t.single_word)
        ]
        self.between = between[-1] if between else None
        self.keeps_spaces = keeps_spaces
        self.normalise = _normaliser(self.tokenizer)
        self.forget()
        examples = [space + word + mark for word in _EXAMPLES for mark in ("", ".", "?!", "##") for space in ("", " ")]
        examples = examples if keeps_spaces else [e for e in examples if e[0] != " "]
        found = self._words([_WORDS.fullmatch(e).groups() for e in examples])
        self.knows_words = found == [x.tobytes() for x in self._each(examples)]

    def forget(self) -> None:
        """The pieces met so far."""
        self.plain, self.spaced, self.words = _Known(""), _Known(" "), {}

    def _normalised(self, words: list[str]) -> list[str]:
        """Words of _LETTERS or _MARKS."""
        return self.normalise(" ".join(words)).split(" ")

    def _model_ids(self, words: list[str]) -> list[bytes]:
        """Ids, as 32-bit numbers, of normalised words by the model alone; a space in front is a letter to it. Each word is looked up once."""
        known, tokenize = self.words, self.tokenizer.model.tokenize
        new = [word for word in dict.fromkeys(words) if word not in known]
        if new:
            text = " ".join([word.lstrip(" ") for word in new])
            # As the model takes them: each byte as its letter.
            letters = text if text.isascii() else text.encode().decode("latin-1").translate(_BYTE_LETTERS)
            for word, own in zip(new, letters.split(" ")):
                known[word] = array("I", [t.id for t in tokenize(_SPACE + own if word[:1] == " " else own)]).tobytes()
        return [known[word] for word in words]

    def _words(self, pieces: list[tuple[str, str, str, str]]) -> list[bytes]:
        """Ids of (space or nothing, first word, marks, rest); marks and rests are often the same."""
        if len(self.words) > MEMO_PIECES:
            # Frequent words are met early.
            self.words = dict(islice(self.words.items(), MEMO_PIECES // 2))
        after = [_PARTS.findall(mark + rest) if rest else (mark,) if mark else () for _, _, mark, rest in pieces]
        parts = dict.fromkeys(chain.from_iterable(after))
        parts.pop("\n", None)
        ids = dict(zip(parts, self._model_ids(self._normalised(list(parts)))))
        # A line end between two words is a token where spaces are kept.
        ids["\n"] = array("I", [t.id for t in self.tokenizer.model.tokenize(_LINE_END)] if self.keeps_spaces else []).tobytes()
        firsts = self._normalised([word for _, word, _, _ in pieces])
        firsts = self._model_ids([before + word for (before, _, _, _), word in zip(pieces, firsts)])
        return [own + b"".join([ids[part] for part in more]) if more else own for own, more in zip(firsts, after)]

    def _each(self, pieces: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch(pieces, add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in found]

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, and how many each has."""
        parts = [_WORDS.fullmatch(p) for p in pieces] if self.knows_words else [None] * len(pieces)
        words = iter(self._words([m.groups() for m in parts if m]))
        others = iter(self._others([p for p, m in zip(pieces, parts) if not m]))
        out = [next(words) if m else next(others).tobytes() for m in parts]
        return np.frombuffer(b"".join(out), np.uint32), np.fromiter(map(len, out), np.int64, len(out)) // 4

    def _others(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of pieces that the library must look at as text."""
        out: list[np.ndarray] = []
        for low in range(0, len(pieces), JOINED):
            part = pieces[low : low + JOINED]
            if self.between is None or any("<|" in p or self.added and self.added.search(p) for p in part):
                out += self._each(part)
                continue
            number, text = self.between
            ids = np.array(self.joined.encode(text.join(part), add_special_tokens=False).ids, np.uint32)
            cuts = np.flatnonzero(ids == number)
            if len(cuts) != len(part) - 1:
                out += self._each(part)
                continue
            starts, ends = np.concatenate([[0], cuts + 1]), np.append(cuts, len(ids))
            out += [ids[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """None counts as an empty text."""
        # Hundreds of thousands of small lists are made here, and none in a circle.
        collects = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _coded_at_spaces(self, texts: list[str | None]) -> list[np.ndarray]:
        """Odd codes of the pieces between any two spaces of each text; pieces that are the same meet before they are looked up."""
        whole = [bool(text and self.added and self.added.search(text)) for text in texts]
        cut = pc.split_pattern(pa.array([None if w else t or None for t, w in zip(texts, whole)], pa.large_string()), " ")
        met = cut.flatten().dictionary_encode()
        find = self.plain.memo.__getitem__
        pieces = met.dictionary.to_numpy(zero_copy_only=False)
        found = np.fromiter(map(find, pieces), np.int64, len(pieces)) * 2 + 1
        found = found[met.indices.to_numpy()]
        bounds = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(cut), 0).to_numpy())])
        return [
            np.array([find(text) * 2 + 1]) if w else found[a:b]
            for text, w, a, b in zip(texts, whole, bounds[:-1].tolist(), bounds[1:].tolist())
        ]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        self.plain.tidy()
        self.spaced.tidy()
        # Codes of pieces with a space in front are even, of others odd.
        plain, spaced = self.plain.memo, self.spaced.memo

        def coded(first: str, rest: list[str]) -> np.ndarray:
            found = np.empty(len(rest) + 1, np.int64)
            found[0] = plain[first] * 2 + 1
            found[1:] = np.fromiter(map(spaced.__getitem__, rest), np.int64, len(rest)) * 2
            return found

        codes = [] if self.keeps_spaces else self._coded_at_spaces(texts)
        for text in texts if self.keeps_spaces else []:
            if not text:
                codes.append(np.zeros(0, np.int64))
            elif self.added and self.added.search(text):
                codes.append(coded(text, []))
            else:
                pieces = text.split(" ")
                codes.append(coded(pieces[0], pieces[1:]))
        if self.keeps_spaces:
            open_plain, open_spaced = self.plain.open_ends(), self.spaced.open_ends()
            for i, found in enumerate(codes):
                if len(found) > 1 and (open_plain[found[0] >> 1] or open_spaced[found[1:] >> 1].any()):
                    first, *rest = _CUT.split(texts[i])
                    codes[i] = coded(first, [p[1:] for p in rest])
        counts = [len(found) for found in codes]
        self.plain.learn(self._pieces)
        self.spaced.learn(self._pieces)
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        number, bare = code >> 1, (code & 1).astype(bool)
        low, size = np.empty(len(code), np.int64), np.empty(len(code), np.int64)
        for known, mine, shift in ((self.spaced, ~bare, 0), (self.plain, bare, len(self.spaced.ids))):
            known.used(number[mine])
            low[mine] = known.bounds[number[mine]] + shift
            size[mine] = known.bounds[number[mine] + 1] - known.bounds[number[mine]]
        ends = np.cumsum(size)
        every = np.concatenate([self.spaced.ids, self.plain.ids])
        ids = every[np.repeat(low - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]
        return ids, bounds


_encoders: dict[tuple[str, bool], TextEncoder] = {}


def encoder(path: str, keeps_spaces: bool) -> TextEncoder:
    """This process's encoder of a vocabulary file; a task that ends has it forget what it has met."""
    key = (path, keeps_spaces)
    if key not in _encoders:
        _encoders[key] = TextEncoder(path, keeps_spaces, added_as_text=False)
    return _encoders[key]


def forget() -> None:
    """The pieces that this process's encoders have met."""
    for code in _encoders.values():
        code.forget()


def text_groups(texts: list[str | None], most: int = 1 << 22):
    """(start, end) of runs of texts with about `most` characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
