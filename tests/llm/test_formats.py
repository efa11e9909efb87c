from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import random
import tracemalloc
import zipfile
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from punctual.llm import idfiles, packing, pieces, queries, tokens, warczip
from punctual.llm.storage import new_folder

ODD = ["", " ", "  two  spaces ", "a\tb\n\nc d", "é ñ 你好 🙂 x", "<|endoftext|> and <|startoftext|>", "It's we'll 12 345!!", "x" * 3000, "\x1c a \x85 b　c", "Á B ́c", "▁x y"]


@pytest.mark.parametrize("path, spaces", [(queries.BYTE_VOCABULARY, True), (queries.WORD_VOCABULARY, False)])
def test_ids_are_those_of_the_library(path, spaces):
    own, library = tokens.TextEncoder(path, spaces), Tokenizer.from_file(path)
    library.encode_special_tokens = True
    rng = random.Random(1)
    alphabet = list("ab  \n\t.,'1é你  s") + ["'s ", " the", "!!"]
    texts = ODD + ["".join(rng.choices(alphabet, k=rng.randrange(40))) for _ in range(800)] + [None]
    for _ in range(2):
        ids, bounds = own.encode(texts)
        for i, text in enumerate(texts):
            expect = library.encode(text or "", add_special_tokens=False).ids
            assert ids[bounds[i] : bounds[i + 1]].tolist() == expect, repr(text)


@pytest.mark.parametrize("path, spaces", [(queries.BYTE_VOCABULARY, True), (queries.WORD_VOCABULARY, False)])
def test_forgetting_changes_nothing(monkeypatch, path, spaces):
    rng = random.Random(7)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.02)), 400)}é" for _ in range(50)) + rng.choice(["", "\n", " "]) for _ in range(300)]
    whole = tokens.TextEncoder(path, spaces).encode(texts)
    monkeypatch.setattr(tokens, "MEMO_PIECES", 60)
    own = tokens.TextEncoder(path, spaces)
    for i in range(0, 300, 10):
        ids, bounds = own.encode(texts[i : i + 10])
        for k in range(10):
            expect = whole[0][whole[1][i + k] : whole[1][i + k + 1]]
            assert (ids[bounds[k] : bounds[k + 1]] == expect).all() and bounds[k + 1] - bounds[k] == len(expect)
    assert len(own.plain.memo) + len(own.spaced.memo) < 400


def documents(spark):
    rows = [(i * 2, " ".join(f"word{i * k % 97}" for k in range(i * 7 % 900))) for i in range(120)]
    rows += [(901, None), (903, ""), (905, rows[50][1]), (905, rows[50][1]), (None, "no id"), (907, "é " * 9000)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, start string")
    library = Tokenizer.from_file(queries.BYTE_VOCABULARY)
    ids = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for _, t in rows]
    return table, rows, ids


def test_packing_places_every_id_once(spark):
    table, rows, ids = documents(spark)
    got = packing.pack_documents(table, queries.BYTE_VOCABULARY, size=256).collect()
    expect = Counter(
        (d, s, min(256, len(x) - s), zlib.crc32(x[s : s + 256].tobytes()), len(x))
        for (d, _), x in zip(rows, ids)
        for s in range(0, len(x), 256)
    )
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == expect
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        end = 0
        for offset, length in sorted(placed):
            assert offset == end
            end += length
        assert end <= 256
    assert sorted(sequences) == list(range(len(sequences)))
    assert sum(map(len, ids)) / (256 * len(sequences)) > 0.9
    assert packing.pack_documents(table.limit(0), queries.BYTE_VOCABULARY).count() == 0


def test_histogram_is_used_up_exactly():
    rng = random.Random(3)
    for size in (8, 64, 2048):
        histogram = {rng.randrange(1, size + 1): rng.randrange(1, 50) for _ in range(40)}
        patterns = packing.pack_histogram(histogram, size)
        used = Counter()
        for pattern, count in patterns:
            assert sum(pattern) <= size and count > 0
            for length in pattern:
                used[length] += count
        assert used == histogram
    assert packing.pack_histogram({}, 8) == []


@pytest.mark.parametrize("lanes, most", [(1, 5), (3, 300), (40, 700)])
def test_blocks_round_trip(lanes, most):
    rng = np.random.default_rng(lanes)
    blocks = [np.minimum(rng.zipf(1.2, most), 65535).astype(np.uint32) for _ in range(lanes)]
    blocks[0][:] = 7
    blocks[-1] = blocks[-1][: most // 2 + 1]
    words = idfiles.encode_blocks(blocks)
    back = idfiles.decode_blocks(words, [len(b) for b in blocks])
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, back))
    if most > 200:
        # What repeats costs nearly nothing.
        assert len(words[0]) * 16 < 0.2 * most + 200 if lanes > 1 else True


def test_random_ids_and_extremes_round_trip():
    rng = np.random.default_rng(4)
    blocks = [rng.integers(0, 65536, 2000).astype(np.uint32) for _ in range(5)]
    blocks += [np.array(list(range(65535, 63535, -1)), np.uint32)]
    words = idfiles.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(blocks, idfiles.decode_blocks(words, [2000] * 6)))


def test_blocks_learn_from_each_other():
    rng = np.random.default_rng(6)
    first = rng.integers(0, 5000, 400).astype(np.uint32)
    # Each block is the one before, ten ids later, so that nothing repeats within a block.
    many = [np.roll(first, 10 * i)[:300] for i in range(30)]
    alone, together = (sum(map(len, idfiles.encode_blocks(b))) for b in ([many[0]], many))
    assert together < 0.5 * alone * len(many)


def test_blocks_that_end_at_any_length_round_trip():
    rng = np.random.default_rng(8)
    blocks = [rng.integers(0, 50, n).astype(np.uint32) for n in (200, 130, 129, 128, 2, 1, 1)]
    words = idfiles.encode_blocks(blocks)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, idfiles.decode_blocks(words, [len(b) for b in blocks])))


@pytest.mark.parametrize("path, spaces", [(queries.BYTE_VOCABULARY, True), (queries.WORD_VOCABULARY, False)])
def test_a_word_goes_to_the_model_once(path, spaces):
    own, library = tokens.TextEncoder(path, spaces), Tokenizer.from_file(path)
    texts = ["a tree, tree. tree! Tree", "tree; (tree) tree\nTree, TREE?"]
    ids, bounds = own.encode(texts)
    for i, text in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text, add_special_tokens=False).ids
    met = [word for word in own.words if word.strip().lower() == "tree"]
    assert 0 < len(met) <= (6 if spaces else 1)


def test_damaged_files_are_refused():
    ids = np.arange(1000, dtype=np.uint32) % 50
    data = b"".join(idfiles.file_bytes([3, None], [600, 400], ids))
    docs, counts, back = idfiles.read_file(io.BytesIO(data))
    assert (docs, counts) == ([3, None], [600, 400]) and (back == ids).all()
    for at in (9, 40, len(data) - 3):
        broken = bytearray(data)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            idfiles.read_file(io.BytesIO(bytes(broken)))
    with pytest.raises(ValueError):
        idfiles.read_file(io.BytesIO(data[:-5]))


def test_id_files_in_order_of_documents(spark):
    table, rows, _ = documents(spark)
    library = Tokenizer.from_file(queries.WORD_VOCABULARY)
    folder = new_folder(spark, "test-ids")
    files = idfiles.write_ids(table, folder, queries.WORD_VOCABULARY)
    got = idfiles.read_ids(files).collect()
    start, expect = 0, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        expect.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == expect
    empty = idfiles.write_ids(table.limit(0), new_folder(spark, "test-ids"), queries.WORD_VOCABULARY)
    assert idfiles.read_ids(empty).count() == 0


def test_segmentation_is_the_best_one():
    codec = pieces.codec(queries.PIECE_VOCABULARY)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_VOCABULARY)
    score = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size()) if not (library.is_byte(i) or library.is_control(i) or library.is_unknown(i))}
    for text in ["the morning", "retitioning  ouen", "naïve café", "a 你 b", "Straße\n", " x "]:
        spaced = (" " + text).replace(" ", "▁")
        best = [0.0] + [-np.inf] * len(spaced)
        for e in range(1, len(spaced) + 1):
            for s in range(e):
                best[e] = max(best[e], best[s] + score.get(spaced[s:e], -np.inf))
            if spaced[e - 1] not in score:
                best[e] = max(best[e], best[e - 1] + codec.unknown_score)
        ids, bounds = codec.encode([text])
        total = 0.0
        for i in ids.tolist():
            total += 0 if library.is_byte(i) else library.get_score(i)
        unknown = sum(c not in score for c in spaced)
        assert total + unknown * codec.unknown_score == pytest.approx(best[-1])
        assert codec.decode(ids, bounds) == [text]


@pytest.mark.parametrize("window", [1, 7, 1000])
@pytest.mark.parametrize("letters", ["a", "ab", "the of and", "日本語の文章をé", "aaab=\U0001f642"])
def test_long_words_in_windows(monkeypatch, window, letters):
    """Ids do not depend on where a long word is cut, and have the best score of any segmentation."""
    codec, rng = pieces.codec(queries.PIECE_VOCABULARY), random.Random(window)
    for n in (1, 2, 60, 3000):
        text = pieces.SPACE + "".join(rng.choices(letters, k=n)).replace(" ", pieces.SPACE)
        monkeypatch.setattr(pieces, "WINDOW", 1 << 30)
        whole = codec.segment(text)
        monkeypatch.setattr(pieces, "WINDOW", window)
        assert codec.segment(text) == whole


def test_a_very_long_word_decodes_and_takes_bounded_memory():
    codec = pieces.codec(queries.PIECE_VOCABULARY)
    text = "".join(random.Random(2).choices("abcdefgh日本語é=", k=300_000))
    ids, bounds = codec.encode([text])
    assert codec.decode(ids, bounds) == [text]
    tracemalloc.start()
    short = codec.segment(text[: 1 << 17])
    held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 65,536 positions are held, whatever the length; the ids found are the rest.
    assert held < 144 * pieces.WINDOW + 64 * len(short)


def test_pieces_decode_to_the_text(spark):
    rows = [(i, t) for i, t in enumerate(ODD + [None, "y " * 50_000])] + [(None, "z"), (3, ODD[3])]
    table = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, ids int")
    encoded = pieces.encode_pieces(table, queries.PIECE_VOCABULARY)
    got = encoded.collect()
    assert len(got) == len(rows) and all(r.round_trip and r.n_ids == len(r.ids) for r in got)
    back = Counter((r.doc_id, r.text) for r in pieces.decode_pieces(encoded, queries.PIECE_VOCABULARY).collect())
    assert back == Counter((d, (t or "").replace("▁", " ")) for d, t in rows)
    assert pieces.encode_pieces(table.limit(0), queries.PIECE_VOCABULARY).count() == 0


def page_rows():
    rows = [(i, f"http://e{i}.com/ü x", f"<p>{i % 7}é</p>" * (i % 5)) for i in range(60)]
    return rows + [(100, None, None), (101, "u", "w" * 6_000_000), (102, "u", "x" * 300), (103, "u", "x" * 300), (None, "u", "x" * 300), (None, "u", "only")]


def test_archives_round_trip(spark):
    rows = page_rows()
    table = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    got = warczip.archive_round_trip(spark, table).collect()
    first = {}
    for p, _, html in rows:
        if p is not None:
            first[html or ""] = min(first.get(html or "", p), p)
    expect = Counter()
    for p, _, html in rows:
        raw = (html or "").encode()
        leads = first.get(html or "") in (p, None)
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        expect[(p, len(raw), digest, "response" if leads else "revisit", None if leads else first[html or ""])] += 1
    assert Counter(map(tuple, got)) == expect
    assert warczip.archive_round_trip(spark, table.limit(0)).count() == 0


def test_packages_are_zip_files_with_an_index(spark, tmp_path):
    rows = page_rows()[:60]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warczip.write_archives(table, str(tmp_path / "packages"), least=10).collect()
    assert sum(r.records for r in manifest) == 60
    found = []
    for path in (r.path for r in manifest):
        with zipfile.ZipFile(path) as package:
            assert package.testzip() is None and package.namelist() == [warczip.ARCHIVE, warczip.INDEX]
            archive = package.read(warczip.ARCHIVE)
            entries = [json.loads(line.partition(" ")[2]) for line in package.read(warczip.INDEX).decode().splitlines()]
        found += [next(warczip.parse_records(archive[e["offset"] : e["offset"] + e["length"]])) for e in entries]
    assert sorted(f["id"] for f in found) == [r[0] for r in rows]
    # Payloads under ten bytes are responses although they repeat.
    assert all(f["record_type"] == "response" for f in found if f["payload_bytes"] < 10)
    assert any(f["record_type"] == "revisit" for f in found)


def test_other_packages(tmp_path):
    """Archives written by the standard library: no ZIP64, no index, a comment, and a compressed member."""
    records = [warczip.record_bytes(i, "u", f"page {i}".encode()) for i in range(5)]
    path = tmp_path / "plain.zip"
    with zipfile.ZipFile(path, "w") as package:
        package.writestr("archive/a.warc", b"".join(records))
        package.writestr("archive/c.warc.gz", b"".join(gzip.compress(r * 1) for r in records))
        package.writestr("archive/b.warc.gz", b"0" * 1000, compress_type=zipfile.ZIP_DEFLATED)
        package.comment = b"a comment PK\x05\x06 with a signature"
    with open(path, "rb") as raw:
        file = pa.PythonFile(raw)
        assert set(warczip.stored_members(file)) == {"archive/a.warc", "archive/c.warc.gz"}
        ranges = list(warczip.record_ranges(file))
        assert len(ranges) == 2
        for start, end in ranges:
            assert [r["id"] for r in warczip.parse_records(warczip._range(file, start, end - start))] == [0, 1, 2, 3, 4]
    # Reading packages doesn't pass over the compressed archive: its records would be missing.
    with pytest.raises(ValueError, match="b.warc.gz"):
        list(warczip._locator([pa.record_batch([pa.array([str(path)])], names=["path"])]))
    (tmp_path / "bad.zip").write_bytes(b"nothing")
    with open(tmp_path / "bad.zip", "rb") as raw, pytest.raises(ValueError):
        warczip.central_directory(pa.PythonFile(raw))


def test_damaged_payload_is_refused():
    record = bytearray(warczip.record_bytes(1, "u", b"payload"))
    record[record.index(b"payload")] ^= 1
    with pytest.raises(ValueError):
        list(warczip.parse_records(bytes(record)))


def test_files_and_ranges_are_read_by_many_tasks(spark, tmp_path):
    """A short list of files is small; joined into one partition, one task would read all of them."""
    docs = spark.createDataFrame([(i, f"text {i} " * 50) for i in range(400)], "doc_id long, text string")
    files = idfiles.write_ids(docs, str(tmp_path / "ids"), queries.WORD_VOCABULARY)
    assert files.count() == 4
    read = idfiles.read_ids(files, with_ids=False)
    assert read.rdd.getNumPartitions() == 4 and read.count() == 400
    pages = docs.selectExpr("doc_id as page_id", "'u' as url", "text as html")
    parts = [warczip.write_archives(pages.where(f"page_id % 3 = {i}"), str(tmp_path / "warc")) for i in range(3)]
    records = warczip.read_archives(parts[0].union(parts[1]).union(parts[2]), with_payload=False)
    assert records.rdd.getNumPartitions() == 3 and records.count() == 400
