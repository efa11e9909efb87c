"""Token-id files: ids of documents in ascending order, packed by an adaptive context-mixing range coder.

The blocks of a file run side by side, one array element each, and learn together: what one step tells
of all blocks is known to all in the next. The last two ids, and the last one, each predict an id through a
table with confidences; the mixture of both, learnt as the blocks go, shares out the coder's range between
"as order 2 says", "as order 1 says" and neither. An id that neither predicts is coded by order-0
frequencies of such ids. Arithmetic is in whole numbers, so that every machine decodes the same.

File, little-endian: magic, version, ids per block, number of documents and ids; for each document its
id, whether it has one, and its number of ids; for each block its number of ids and words, the CRC-32 of
its ids and of its words; the CRC-32 of all that; then the words of the blocks. Blocks are decoded in
groups of 8,192, as they were coded.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from punctual.llm.storage import dealt, freeing, new_folder, stored
from punctual.llm.tokens import encoder, text_groups
from punctual.llm.warczip import _open

MAGIC, VERSION = b"PIDF", 2
BLOCK_IDS = 1024
#: Ids after which a file ends (with the document that reaches it), and blocks coded side by side.
FILE_IDS, LANES = 1 << 23, 8192
END_ID = 1
#: Ids that there may be, bits of the table of order 2, how sure a prediction can be.
_IDS, _TABLE, _SURE = 1 << 16, 16, 15
#: Parts of the range for the predictions, and of each of these for the ids.
_ONE, _SLOTS = 1 << 12, 1 << 18
#: The coder's numbers are whole and below 2^48, exact as floats, which are divided faster than integers.
_TOP, _LEAST, _WORD, _SHARE = float(1 << 48), float(1 << 32), float(1 << 16), 1 / (_ONE * _SLOTS)
_HEAD = struct.Struct("<4sIIQQ")


class _Mixer:
    """What the ids coded so far, of all blocks side by side, say about the next id of each block."""

    def __init__(self, lanes: int):
        # A prediction and how sure it is (four bits), for each last id and for each hash of the last two.
        self.order1, self.order2 = np.zeros(_IDS, np.int32), np.zeros(1 << _TABLE, np.int32)
        self.last = np.zeros((2, lanes), np.int64)
        self.seen, self.counts = _PRIOR.copy(), np.zeros(_IDS + 1, np.int64)
        self.fresh: list[np.ndarray] = []

    def _order0(self) -> None:
        """Places of the ids, in 2^18, by how often they came unpredicted; every id has one."""
        if self.fresh:
            self.counts += np.bincount(np.concatenate(self.fresh), minlength=_IDS + 1)
            self.fresh = []
        counts = self.counts[:_IDS]
        size = 1 + counts * (_SLOTS - _IDS) // max(int(counts.sum()), 1)
        # What rounding left goes to the most frequent id.
        size[size.argmax()] += _SLOTS - size.sum()
        self.value = np.repeat(np.arange(_IDS, dtype=np.uint16), size)
        # The last element stands for predicted ids, which need no place.
        # Begin and size in one array element: one look-up instead of two.
        self.places = np.empty(_IDS + 1, np.complex64)
        self.places.real, self.places.imag = np.append(np.cumsum(size) - size, 0), np.append(size, _SLOTS)

    def _mix(self) -> None:
        """How the range is shared out in each context: order 2 first, then order 1, then the rest."""
        total = self.seen.sum(axis=1)
        f2 = np.clip(self.seen[:, 0] * _ONE // total, 1, _ONE - 2)
        f1 = np.clip(self.seen[:, 1] * _ONE // total, 1, _ONE - 1 - f2)
        self.end2, self.end1 = (f2 * _SLOTS).astype(float), ((f2 + f1) * _SLOTS).astype(float)
        begin = np.stack([0 * f2, f2, f2 + f1, 0 * f2], axis=1) * _SLOTS
        self.part_begin, self.part_size = (x.astype(float).reshape(-1) for x in (begin, np.stack([f2, f1, _ONE - f2 - f1, f2], axis=1)))

    def predict(self, n: int, step: int) -> np.ndarray:
        """Two ids for each of the first n blocks; the contexts, in which shares of the range are learnt."""
        if step & (step - 1) == 0 or step % 128 == 0:
            self._order0()
        if step < 32 or step % 16 == 0:
            self._mix()
        self.step = step
        a, b = self.last[0, :n], self.last[1, :n]
        self.at1, self.at2 = a, ((a * 0x9E3779B1 >> 20) ^ b) & ((1 << _TABLE) - 1)
        self.entry1, self.entry2 = self.order1.take(a, mode="clip"), self.order2.take(self.at2, mode="clip")
        self.id1, self.id2 = self.entry1 >> 4, self.entry2 >> 4
        context = ((self.entry2 & _SURE) << 5) | ((self.entry1 & _SURE) << 1)
        context += self.id1 == self.id2
        return context.astype(np.int64)

    def place(self, part: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and length, in 2^30, of the parts of the range: which prediction was right, and else the id."""
        size, places = self.part_size.take(part, mode="clip"), self.places.take(coded, mode="clip")
        begin = places.real * size
        begin += self.part_begin.take(part, mode="clip")
        size *= places.imag
        return begin, size

    def learn(self, n: int, ids: np.ndarray, part: np.ndarray, coded: np.ndarray) -> None:
        """A prediction that was wrong loses half of its sureness, or its place to the id that came."""
        # Later on every fourth step tells enough.
        if self.step < 64 or self.step % 4 == 0:
            self.seen.reshape(-1)[:] += np.bincount(part, minlength=self.seen.size)
            self.fresh.append(coded)
        new = ids.astype(np.int32) << 4
        for table, at, entry, (kept, change) in ((self.order2, self.at2, self.entry2, _LEARN2), (self.order1, self.at1, self.entry1, _LEARN1)):
            entry ^= new
            entry &= kept.take(part, mode="clip")
            entry ^= new
            entry += change.take(part, mode="clip")
            # Of blocks that meet in an element the last one counts.
            table[at] = entry
        self.last[1, :n] = self.last[0, :n]
        self.last[0, :n] = ids


def _learning() -> tuple[np.ndarray, tuple, tuple]:
    """For each part (context, which prediction was right): numbers to begin with, and what happens to both predictions."""
    context = np.arange(512)
    sure2, sure1, same = context >> 5, context >> 1 & _SURE, context & 1
    prior = np.stack([1 + 2 * sure2, 1 + (1 - same) * sure1 * (_SURE - sure2) // 8, 31 - 2 * np.maximum(sure2, sure1), 0 * context], axis=1)
    nothing = np.zeros(512, bool)

    def rules(sure: np.ndarray, right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        was = np.stack(right, axis=1)
        sure = sure[:, None]
        kept = np.where(was | (sure > 0), -1, 0)
        change = np.where(was, sure < _SURE, -(sure + 1 >> 1))
        return kept.astype(np.int32).reshape(-1), change.astype(np.int32).reshape(-1)

    return prior, rules(sure2, [~nothing, nothing, nothing, nothing]), rules(sure1, [same == 1, ~nothing, nothing, nothing])


_PRIOR, _LEARN2, _LEARN1 = _learning()


def _running(sizes: np.ndarray) -> list[int]:
    """For each step, how many blocks have an id there; blocks come longest first."""
    return np.searchsorted(-sizes, -np.arange(sizes[0]), "left").tolist()


def encode_blocks(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Words of every block; blocks come longest first."""
    lanes, most = len(blocks), len(blocks[0])
    sizes = np.array([len(b) for b in blocks])
    ids = np.zeros((lanes, most), np.uint16)
    for i, block in enumerate(blocks):
        ids[i, : len(block)] = block
    ids = np.ascontiguousarray(ids.T)
    mixer = _Mixer(lanes)
    low, size = np.zeros(lanes), np.full(lanes, _TOP - 1)
    # Carries wait in the place of the next word until all words are there.
    words, carries = np.zeros((2 * most + 4) * lanes, np.uint16), np.zeros((2 * most + 4) * lanes, np.uint8)
    at = np.arange(lanes)
    for step, n in enumerate(_running(sizes)):
        context = mixer.predict(n, step)
        x = ids[step, :n].astype(np.int64)
        wrong2, wrong1 = mixer.id2 != x, mixer.id1 != x
        missed = (wrong2 & wrong1).astype(np.int64)
        part = (context << 2) + wrong2 + missed
        coded = (x & -missed) | ((1 - missed) << 16)
        begin, length = mixer.place(part, coded)
        mixer.learn(n, x, part, coded)
        unit = np.floor(size[:n] * _SHARE)
        low[:n] += unit * begin
        over = np.flatnonzero(low[:n] >= _TOP)
        carries[at[over]] += 1
        low[over] -= _TOP
        size[:n] = unit * length
        due = np.flatnonzero(size[:n] < _LEAST)
        while len(due):
            word = np.floor(low[due] * (1 / _LEAST))
            place = at[due]
            words[place] = word
            at[due] = place + lanes
            low[due] = (low[due] - word * _LEAST) * _WORD
            size[due] *= _WORD
            due = due[size[due] < _LEAST]
    for _ in range(3):
        word = np.floor(low * (1 / _LEAST))
        words[at] = word
        at += lanes
        low = (low - word * _LEAST) * _WORD
    words, carries, at = words.reshape(-1, lanes), carries.reshape(-1, lanes), at // lanes
    carry = np.zeros(lanes, np.int32)
    for k in range(int(at.max()) - 1, -1, -1):
        carry += words[k]
        carry += carries[k + 1]
        words[k] = carry & 0xFFFF
        carry >>= 16
    words = np.ascontiguousarray(words[: at.max()].T)
    return [words[i, :n].copy() for i, n in enumerate(at.tolist())]


def decode_blocks(words: list[np.ndarray], sizes: list[int]) -> list[np.ndarray]:
    """Ids of blocks from their words and numbers of ids; blocks come longest first."""
    lanes, most = len(words), sizes[0]
    counts = np.array(sizes)
    width = max(map(len, words)) + 1
    code = np.zeros((lanes, width), np.uint16)
    for i, own in enumerate(words):
        code[i, : len(own)] = own
    code = code.reshape(-1)
    mixer = _Mixer(lanes)
    # How far the code lies above the low end of the range.
    at, above, size = np.arange(lanes) * width, np.zeros(lanes), np.full(lanes, _TOP - 1)
    for _ in range(3):
        above = above * _WORD + code[at]
        at += 1
    ids = np.zeros((most, lanes), np.uint16)
    for step, n in enumerate(_running(counts)):
        context = mixer.predict(n, step)
        unit = np.floor(size[:n] * _SHARE)
        slot = np.minimum(np.floor(above[:n] / unit), _ONE * _SLOTS - 1)
        wrong2 = slot >= mixer.end2.take(context, mode="clip")
        missed = (slot >= mixer.end1.take(context, mode="clip")).astype(np.int64)
        part = (context << 2) + wrong2 + missed
        # For predicted ids this finds some id, which the masks leave out.
        slot -= mixer.part_begin.take(part, mode="clip")
        slot /= mixer.part_size.take(part, mode="clip")
        found = mixer.value.take(slot.astype(np.int64), mode="clip").astype(np.int64) & -missed
        said = mixer.id2 ^ ((mixer.id1 ^ mixer.id2) & -wrong2.astype(np.int32))
        x = found | (said & (missed - 1))
        coded = found | ((1 - missed) << 16)
        begin, length = mixer.place(part, coded)
        mixer.learn(n, x, part, coded)
        ids[step, :n] = x
        above[:n] -= unit * begin
        size[:n] = unit * length
        due = np.flatnonzero(size[:n] < _LEAST)
        while len(due):
            place = at[due]
            above[due] = above[due] * _WORD + code[place]
            at[due] = place + 1
            size[due] *= _WORD
            due = due[size[due] < _LEAST]
    ids = np.ascontiguousarray(ids.T)
    return [ids[i, :n].astype(np.uint32) for i, n in enumerate(counts.tolist())]


def file_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, block_ids: int = BLOCK_IDS) -> Iterator[bytes]:
    """A file, part by part. Ids are below 65,536."""
    if len(ids) and int(ids.max()) >> 16:
        raise ValueError("ids of more than 16 bits")
    blocks = [ids[i : i + block_ids] for i in range(0, len(ids), block_ids)]
    words = []
    for i in range(0, len(blocks), LANES):
        words += encode_blocks(blocks[i : i + LANES])
    payloads = [w.astype("<u2").tobytes() for w in words]
    table = b"".join(struct.pack("<qBI", d or 0, d is not None, n) for d, n in zip(doc_ids, counts))
    directory = b"".join(
        struct.pack("<IIII", len(b), len(w), zlib.crc32(b.astype("<u4").tobytes()), zlib.crc32(p))
        for b, w, p in zip(blocks, words, payloads)
    )
    head = _HEAD.pack(MAGIC, VERSION, block_ids, len(doc_ids), len(ids)) + table + directory
    yield head + struct.pack("<I", zlib.crc32(head))
    yield from payloads


def read_file(file) -> tuple[list[int | None], list[int], np.ndarray]:
    """Document ids, their numbers of ids, and all ids, every checksum tested."""

    def take(n: int) -> bytes:
        data = file.read(n)
        if len(data) != n:
            raise ValueError("id file ends early")
        return data

    head = take(_HEAD.size)
    magic, version, block_ids, n_docs, n_ids = _HEAD.unpack(head)
    if magic != MAGIC or version != VERSION:
        raise ValueError("no id file of this version")
    n_blocks = -(-n_ids // block_ids)
    rest = take(13 * n_docs + 16 * n_blocks)
    if zlib.crc32(head + rest) != struct.unpack("<I", take(4))[0]:
        raise ValueError("head of id file is damaged")
    table = list(struct.iter_unpack("<qBI", rest[: 13 * n_docs]))
    directory = list(struct.iter_unpack("<IIII", rest[13 * n_docs :]))
    out = []
    for i in range(0, n_blocks, LANES):
        part, words = directory[i : i + LANES], []
        for k, (_, n_words, _, crc) in enumerate(part):
            data = take(2 * n_words)
            if zlib.crc32(data) != crc:
                raise ValueError(f"words of block {i + k} are damaged")
            words.append(np.frombuffer(data, "<u2"))
        for k, block in enumerate(decode_blocks(words, [p[0] for p in part])):
            if zlib.crc32(block.astype("<u4").tobytes()) != part[k][2]:
                raise ValueError(f"ids of block {i + k} are damaged")
            out.append(block)
    ids = np.concatenate(out) if out else np.zeros(0, np.uint32)
    return [d if has else None for d, has, _ in table], [n for _, _, n in table], ids


def _writer(folder: str, vocabulary: str, keeps_spaces: bool, end_id: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task = encoder(vocabulary, keeps_spaces), TaskContext.get()
        part = task.partitionId() if task else 0
        system, root = _open(folder)
        docs: list[int | None] = []
        counts: list[int] = []
        held: list[np.ndarray] = []
        total, number = 0, 0

        def flush() -> pa.RecordBatch:
            # A name of its own for every attempt: a lost attempt's file is in no manifest.
            name = f"ids-{uuid.uuid4().hex}"
            with system.open_output_stream(f"{root}/{name}") as out:
                for piece in file_bytes(docs, counts, np.concatenate(held)):
                    out.write(piece)
            row = {"path": f"{folder}/{name}", "part": part, "number": number, "n_docs": len(docs), "n_ids": total}
            return pa.RecordBatch.from_pylist([row])

        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("doc").to_pylist()
            for i, j in text_groups(texts):
                ids, bounds = code.encode(texts[i:j])
                for k in range(j - i):
                    if not docs and number == 0:
                        system.create_dir(root, recursive=True)
                    own = np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id))
                    docs.append(names[i + k])
                    counts.append(len(own))
                    held.append(own)
                    total += len(own)
                    if total >= FILE_IDS:
                        yield flush()
                        docs, counts, held, total, number = [], [], [], 0, number + 1
        if docs:
            yield flush()

    return run


def write_ids(
    docs: DataFrame,
    folder: str,
    vocabulary: str,
    keeps_spaces: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = END_ID,
) -> DataFrame:
    """Write the ids of every text and end_id into files below folder; (path, part, number, n_docs, n_ids).

    Documents are in ascending order of id over the files in order of (part, number), NULL ids first and
    rows of one id by their text. NULL and empty texts have end_id alone. keeps_spaces says that words of
    the vocabulary carry the space in front of them. An empty table writes nothing. Vocabularies have less
    than 65,536 ids: larger ids are an error, as none would come back. A text of n ids takes some 40 bytes
    an id of one task's memory; a file ends with the document that fills it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "doc").sortWithinPartitions("doc", "text")
    schema = "path string, part long, number long, n_docs long, n_ids long"
    return stored(rows.mapInArrow(freeing(_writer(folder, vocabulary, keeps_spaces, end_id)), schema), "id-files")


def _reader(with_ids: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                system, own = _open(path)
                with system.open_input_stream(own) as file:
                    docs, counts, ids = read_file(file)
                ends = np.cumsum(counts)
                raw = ids.astype("<u4")
                crcs = [zlib.crc32(raw[e - n : e].tobytes()) for e, n in zip(ends.tolist(), counts)]
                columns = [
                    pa.array(docs, pa.int64()),
                    pa.array(start + ends - counts),
                    pa.array(counts, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ]
                names = ["doc", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    bounds = np.concatenate([[0], ends]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(ids.astype(np.int32))))
                    names.append("ids")
                yield pa.record_batch(columns, names=names)

    return run


def read_ids(files: DataFrame, with_ids: bool = True, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files: id, start, n_tokens, ids_crc32 and its ids.

    A task reads a file or a few. start counts the ids of all documents before it. Files are read whole, one by one, in any order.
    """
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each file of eight million ids: a single sorted pass over these is small.
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    schema = "doc long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return dealt(placed, files.count(), "path").mapInArrow(freeing(_reader(with_ids)), schema).withColumnRenamed("doc", id_col)


def id_file_round_trip(spark: SparkSession, docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files written of them."""
    return read_ids(write_ids(docs, new_folder(spark, "ids"), vocabulary), with_ids=False)
