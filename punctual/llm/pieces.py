"""Encoding and decoding with a SentencePiece vocabulary, by an Aho-Corasick automaton and one Viterbi pass.

The automaton is built over the pieces. It reads a text once; at each position its output links name
every piece that ends there, longest first, and each of them relaxes the best score of a segmentation
up to that position. Pieces have spaces at their front only, so the best segmentation of a text is that
of its words one after another, and a task works out each distinct word once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from punctual.llm.tokens import text_groups

SPACE = "▁"
#: How far below the worst piece an unknown character scores; a fixed value of the format.
UNKNOWN_PENALTY = 10.0
#: Words, and characters in them, that a task remembers before it starts anew.
MEMO_WORDS, MEMO_CHARS = 400_000, 16_000_000
#: Positions of a word that are held until ids that no longer change are emitted.
WINDOW = 1 << 16


class _Memo(dict):
    def __init__(self):
        self.new = []

    def __missing__(self, word: str) -> int:
        code = self[word] = len(self)
        self.new.append(word)
        return code


class PieceCodec:
    """encode(texts) gives all ids and the bounds of each text's; decode(ids, bounds) gives the texts back."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        vocabulary = sentencepiece.SentencePieceProcessor(model_file=path)
        n = vocabulary.get_piece_size()
        self.unknown = vocabulary.unk_id()
        self.bytes = np.full(256, -1, np.int64)
        automaton, scores, spoken = ahocorasick.Automaton(), [], []
        inner = False
        for i in range(n):
            piece = vocabulary.id_to_piece(i)
            if vocabulary.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                spoken.append(bytes([int(piece[3:5], 16)]))
            elif vocabulary.is_unknown(i):
                spoken.append(" ⁇ ".encode())
            elif vocabulary.is_control(i) or vocabulary.is_unused(i):
                spoken.append(b"")
            else:
                score = vocabulary.get_score(i)
                automaton.add_word(piece, (len(piece), score, i))
                scores.append(score)
                inner |= SPACE in piece.lstrip(SPACE)
                spoken.append(piece.replace(SPACE, " ").encode())
        automaton.make_automaton()
        self.automaton, self.by_words = automaton, not inner
        self.longest = max(length for length, _, _ in automaton.values())
        self.unknown_score = min(scores) - UNKNOWN_PENALTY
        self.spoken_bounds = np.concatenate([[0], np.cumsum([len(s) for s in spoken])])
        self.spoken = np.frombuffer(b"".join(spoken), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.memo, self.chars = _Memo(), 0
        self.bounds, self.ids = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation; of equal ones, that whose last piece is longest, and so on.

        Positions count from `base`. When `room` of them are used, what all segmentations still open have in
        common is emitted and base moves on, so a word of any length takes little memory.
        """
        n, base, out = len(text), 0, []
        room = min(n, WINDOW)
        best, back = [0.0] + [-np.inf] * room, [(0, -1)] * (room + 1)
        done, single = 0, False
        # After the last match, one that changes nothing at the end of the text.
        for at, (length, score, i) in chain(self.automaton.iter(text), [(n - 1, (0, -np.inf, -1))]):
            end = at + 1 - base
            while end > room:
                while done < room:
                    done = self._close(done, single, best, back)
                    single = False
                common = self._common(done, back)
                out += self._ids(text, base, common, back)
                base, end, done = base + common, end - common, done - common
                room = min(n - base, done + WINDOW)
                best = best[common:] + [-np.inf] * (room - done)
                back = back[common:] + [(0, -1)] * (room - done)
            while done < end - 1:
                # Positions passed: a character that is no piece by itself may be unknown.
                done = self._close(done, single, best, back)
                single = False
            total = best[end - length] + score
            if total > best[end]:
                best[end], back[end] = total, (length, i)
            single = single or length == 1
        while done < n - base:
            done = self._close(done, single, best, back)
            single = False
        return out + self._ids(text, base, done, back)

    def _close(self, done: int, single: bool, best: list, back: list) -> int:
        end = done + 1
        if not single and best[done] + self.unknown_score > best[end]:
            best[end], back[end] = best[done] + self.unknown_score, (1, -1)
        return end

    def _common(self, done: int, back: list) -> int:
        """The last position on the best ways to all positions where a piece that ends after `done` may start."""
        ways = set(range(max(0, done - self.longest), done + 1))
        while len(ways) > 1:
            latest = max(ways)
            ways.remove(latest)
            ways.add(latest - back[latest][0])
        return ways.pop()

    def _ids(self, text: str, base: int, end: int, back: list) -> list[int]:
        """Ids of the best way from base to the position `end` after it."""
        out = []
        while end:
            length, i = back[end]
            if i >= 0:
                out.append(i)
            else:
                raw = self.bytes[list(text[base + end - 1].encode())]
                out.extend(raw[::-1].tolist() if (raw >= 0).all() else [self.unknown])
            end -= length
        return out[::-1]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """None and the empty text have no ids. A space is put before every other text."""
        if len(self.memo) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self._forget()
        find, codes, counts = self.memo.__getitem__, [], []
        for text in texts:
            if not text:
                counts.append(0)
                continue
            spaced = " " + text.replace(SPACE, " ")
            if not self.by_words:
                words = [spaced.replace(" ", SPACE)]
            elif "  " in spaced or spaced[-1] == " ":
                words = [w.replace(" ", SPACE) for w in re.findall(" +[^ ]*", spaced)]
            else:
                words = spaced[1:].split(" ")
                codes.append(np.fromiter(map(find, words), np.int64, len(words)))
                counts.append(len(words))
                continue
            # Words with other than one space in front are remembered with their spaces.
            codes.append(np.fromiter(map(find, (w[1:] if w[1:2] != SPACE and len(w) > 1 else "\n" + w for w in words)), np.int64, len(words)))
            counts.append(len(words))
        new, self.memo.new = self.memo.new, []
        found = [self.segment(w[1:] if w[:2] == "\n" + SPACE else SPACE + w) for w in new]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(sizes)])
        flat = np.fromiter((i for ids in found for i in ids), np.int32, int(sizes.sum()))
        self.ids = np.concatenate([self.ids, flat])
        self.chars += sum(map(len, new))
        code = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        low = self.bounds[code]
        size = self.bounds[code + 1] - low
        ends = np.cumsum(size)
        ids = self.ids[np.repeat(low - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        return ids, np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """Texts of ids; the space put before a text is taken off, bytes that are no UTF-8 are replaced."""
        low = self.spoken_bounds[ids]
        size = self.spoken_bounds[ids + 1] - low
        ends = np.cumsum(size)
        raw = self.spoken[np.repeat(low - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        at = np.concatenate([[0], ends])[bounds]
        texts = [raw[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        return [(t[1:] if t[:1] == b" " else t).decode("utf-8", "replace") for t in texts]


_codecs: dict[str, PieceCodec] = {}


def codec(path: str) -> PieceCodec:
    """This process's codec of a vocabulary file."""
    if path not in _codecs:
        _codecs[path] = PieceCodec(path)
    return _codecs[path]


def _coder(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in text_groups(texts):
                ids, bounds = own.encode(texts[i:j])
                back = own.decode(ids, bounds)
                same = [b == (t or "").replace(SPACE, " ") for b, t in zip(back, texts[i:j])]
                raw = ids.astype("<u4")
                crcs = [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.record_batch(
                    [
                        batch.column("doc").slice(i, j - i),
                        pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids, pa.int32())),
                        pa.array(np.diff(bounds)),
                        pa.array(crcs, pa.int64()),
                        pa.array(same, pa.bool_()),
                    ],
                    names=["doc", "ids", "n_ids", "ids_crc32", "round_trip"],
                )

    return run


def encode_pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ids, n_ids, ids_crc32, round_trip (decoding the ids gives the text back).

    The scores of the vocabulary file are taken as log-probabilities of a unigram model. Characters that
    no piece has become byte pieces, or the unknown id in vocabularies without them (then round_trip is
    false). U+2581 stands for a space and decodes to one. NULL and empty texts have no ids. Rows are
    independent: repeated and NULL ids are kept. An empty table gives no rows; other columns are not read.
    A very long text takes some 30 bytes a character of one task's memory, also if it holds no space.
    """
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc"].dataType.simpleString()
    out = texts.mapInArrow(
        _coder(vocabulary), f"doc {kind}, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean"
    )
    return out.withColumnRenamed("doc", id_col)


def decode_pieces(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of rows with ids; NULL ids give a NULL text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = []
            for ids in batch.column("ids"):
                flat = np.asarray(ids.values.to_numpy(zero_copy_only=False), np.int64) if ids.is_valid else None
                texts.append(None if flat is None else own.decode(flat, np.array([0, len(flat)]))[0])
            yield pa.record_batch([batch.column("doc"), pa.array(texts, pa.string())], names=["doc", "text"])

    rows = encoded.select(F.col(id_col).alias("doc"), F.col(ids_col).alias("ids"))
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, text string").withColumnRenamed("doc", id_col)
