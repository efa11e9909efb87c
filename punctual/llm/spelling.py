"""Spelling variants: words one edit apart, found with a bit-sliced index of positions.

The index of some words is one bitset over them for each (position, letter): whose letter there is it.
All queries run through it at once, letter by letter. Four bitsets a query say which words agree with
the letters read so far without an error, with one letter replaced, with one more letter and with one
letter less; each follows from the last ones by an AND with the bitset of the next letter at the same
position, one further on or one back, 64 words in one operation.

No index covers the whole vocabulary. Two words one edit apart agree in two of three pieces of the
shorter one, so each word goes, for its own length and the next smaller one, to three buckets by what
two pieces say, and is compared with the words of its buckets only. A pair may meet in several buckets
and counts in the one that the length of its common beginning names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from punctual.llm.storage import salted_left_join, stored

WORD = re.compile("[A-Za-zÀ-ÿ]+")
LETTERS, OCCURRENCES, FACTOR = 6, 5, 5
#: Words, and letters in them, that a task counts before it passes the counts on.
COUNTED, COUNTED_LETTERS = 200_000, 8_000_000
#: Rows of one bucket, on average; a key with more than BLOCK rows is cut into blocks that meet two by two.
BUCKET, BLOCK = 1024, 4096
#: Words longer than this meet only words of about their length, not any that share a bucket.
LONG = 40
_AB, _AC, _BC = 0, 1, 2


def _counter(letters: int, slips: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        size = 0

        def counts() -> pa.RecordBatch:
            return pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            docs, texts = batch.column("doc").to_pylist(), batch.column("text")
            for i, doc in enumerate(docs):
                if not texts[i].is_valid:
                    continue
                # Lowering bytes changes A-Z alone.
                text = texts[i].as_buffer().to_pybytes().lower().decode()
                begin = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(WORD.findall(text)).items():
                    h = zlib.crc32(word.encode(), begin) if slips else 1
                    if slips and h % slips == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                    if len(word) >= letters:
                        if word not in total:
                            size += len(word)
                        total[word] += n
                if len(total) >= COUNTED or size >= COUNTED_LETTERS:
                    yield counts()
                    total, size = Counter(), 0
        if total:
            yield counts()

    return run


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", letters: int = LETTERS, slips: int = 0
) -> DataFrame:
    """(word, n): words of at least `letters` letters, A-Z lower-cased, and how often they occur.

    Words are the longest runs of A-Z, a-z and U+00C0-U+00FF. With `slips`, a word of a document whose
    crc32 of "<id>:<word>" is a multiple of it loses the letter at that number modulo its length: known
    misspellings for a test. NULL and empty texts have no words; a NULL id counts as an empty one;
    repeated rows count again. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("text"))
    parts = rows.mapInArrow(_counter(letters, slips), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One row of letters for each word, from 1, then zeros; and the words' lengths."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    table = np.zeros((len(words), int(sizes.max())), np.uint8)
    # a-z are 1 to 26, U+00C0 to U+00FF the 64 after them.
    table[np.arange(table.shape[1]) < sizes[:, None]] = np.where(flat < 0xC0, flat - 0x60, flat - 0xC0 + 27)
    return table, sizes


def _bits(mask: np.ndarray) -> np.ndarray:
    """Rows of truth values as rows of 64-bit words; the number of columns is a multiple of 64."""
    return np.packbits(mask, axis=-1, bitorder="little").view(np.uint64)


def one_edit_pairs(
    letters: np.ndarray, sizes: np.ndarray, indexed: np.ndarray | None = None, indexed_sizes: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) of all words i and indexed words j that differ by exactly one inserted, deleted or replaced letter."""
    if indexed is None:
        indexed, indexed_sizes = letters, sizes
    n, width = len(indexed), max(letters.shape[1], indexed.shape[1]) + 2
    room = -(-n // 64) * 64
    alphabet = np.arange(1 + int(max(letters.max(), indexed.max())), dtype=np.uint8)[:, None]

    def slice_at(position: int) -> np.ndarray:
        """The index's bitsets of one position, one for each letter; none has letter 0."""
        mask = np.zeros((len(alphabet), room), bool)
        if 0 <= position < indexed.shape[1]:
            mask[1:, :n] = indexed[:, position] == alphabet[1:]
        return _bits(mask)

    of_size = np.zeros((width + 2, room), bool)
    known = indexed_sizes + 1 < len(of_size)
    of_size[indexed_sizes[known], np.flatnonzero(known)] = True
    of_size = _bits(of_size)

    order = np.argsort(-sizes, kind="stable")
    letters, sizes = letters[order], sizes[order]
    exact = np.repeat(_bits(np.arange(room) < n)[None, :], len(sizes), axis=0)
    replaced, longer, shorter = (np.zeros_like(exact) for _ in range(3))
    last, here, ahead = slice_at(-1), slice_at(0), slice_at(1)
    rows, columns = [], []
    left = len(sizes)
    for i in range(letters.shape[1] + 1):
        # Queries whose letters are all read; they stand behind the longer ones.
        done = int(np.searchsorted(-sizes, -i, "left"))
        if done < left:
            zero, same = exact[done:left], of_size[i]
            near = (replaced[done:left] & ~zero & same) | ((longer[done:left] | zero) & of_size[i + 1])
            near |= shorter[done:left] & (of_size[i - 1] if i else np.uint64(0))
            r, w = np.nonzero(near)
            k, bit = np.nonzero(np.unpackbits(near[r, w].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            rows.append(order[done + r[k]])
            columns.append(w[k] * 64 + bit)
            left = done
            exact, replaced, longer, shorter = exact[:left], replaced[:left], longer[:left], shorter[:left]
        if not left:
            break
        letter = letters[:left, i]
        shorter &= last[letter]
        shorter |= exact
        longer |= exact
        longer &= ahead[letter]
        agrees = here[letter]
        replaced &= agrees
        replaced |= exact
        exact = exact & agrees
        last, here, ahead = here, ahead, slice_at(i + 2)
    return np.concatenate(rows), np.concatenate(columns)


def _common_beginning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal letters at the beginning of each pair of rows; the rows differ."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    return np.argmax(a != b, axis=1)


def _pairs_of_bucket(table: pa.Table) -> pa.Table:
    """Directed pairs that count in this bucket. `own` is a row's block; two blocks meet across only."""
    words, number = table.column("word"), table.column("n")
    size, kind, own = (table.column(c).to_numpy() for c in ("size", "kind", "own"))
    letters, sizes = _letters(words.to_pylist())
    across = table.column("low")[0] != table.column("high")[0]
    found = []
    for low in range(0, len(words), BLOCK):
        for begin in range(0, len(words), BLOCK):
            part, other = slice(low, low + BLOCK), slice(begin, begin + BLOCK)
            i, j = one_edit_pairs(letters[part], sizes[part], letters[other], sizes[other])
            i, j = i + low, j + begin
            # Both have the bucket's length, or one of them does and the other has one letter more.
            meets = (size[i] == size[j]) & (kind[i] == kind[j]) & (np.minimum(sizes[i], sizes[j]) == size[i])
            if across:
                meets &= own[i] != own[j]
            i, j = i[meets], j[meets]
            begins = _common_beginning(letters[i], letters[j]) if len(i) else np.zeros(0, np.int64)
            names = np.where(begins >= 2 * size[i] // 3, _AB, np.where(begins >= size[i] // 3, _AC, _BC))
            found.append(np.column_stack([i, j])[names == kind[i]])
    at = np.concatenate(found)
    # Two keys of one bucket may have the same two words.
    code = np.unique(at[:, 0] * np.int64(len(words)) + at[:, 1])
    i, j = pa.array(code // len(words)), pa.array(code % len(words))
    columns = [words.take(i), number.take(i), words.take(j), number.take(j)]
    return pa.table(columns, names=["word", "n", "near", "near_n"])


def near_pairs(vocabulary: DataFrame, letters: int = LETTERS) -> DataFrame:
    """(word, n, near, near_n) of all ordered pairs of words of (word, n) that are one edit apart.

    Words are distinct, not NULL, of letters a-z and U+00C0-U+00FF and of `letters` letters or more.
    """
    size = F.length("word")
    keys = []
    for shift in (0, 1):
        # The word as one of `m` letters, or as one with a letter more; pieces are those of m letters.
        m = size - shift
        one, two = F.floor(m / 3).cast("int"), F.floor(2 * m / 3).cast("int")
        texts = {
            _AB: F.substring("word", F.lit(1), two),
            _AC: F.concat(F.substring("word", F.lit(1), one), F.substring("word", two + shift + 1, size)),
            _BC: F.substring("word", one + shift + 1, size),
        }
        keys += [
            F.struct(m.alias("size"), F.lit(kind).alias("kind"), F.xxhash64(m, F.lit(kind), text).alias("key"))
            for kind, text in texts.items()
        ]
    rows = vocabulary.select("word", "n", F.inline(F.array(*keys))).where(F.col("size") >= letters)
    buckets = max(1, -(-6 * vocabulary.count() // BUCKET))
    hot = stored(rows.groupBy("key").count().where(F.col("count") > BLOCK), "hot-pieces")
    rows = rows.join(hot, "key", "left")
    blocks = F.coalesce(F.ceil(F.col("count") / BLOCK), F.lit(1)).cast("int")
    rows = rows.select(
        "word",
        "n",
        "size",
        "kind",
        F.when(F.col("count").isNotNull(), F.col("key")).alias("hot"),
        F.when(F.col("size") > LONG, F.col("size")).alias("band"),
        F.pmod("key", F.lit(buckets)).alias("bucket"),
        F.pmod(F.xxhash64("word"), blocks).cast("int").alias("own"),
        F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"),
    )
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
    # The grouping columns go through Python with every row; only these few numbers do.
    grouped = rows.select("word", "n", "size", "kind", "own", "hot", "band", "bucket", "low", "high").groupBy(
        "hot", "band", "bucket", "low", "high"
    )
    return grouped.applyInArrow(_pairs_of_bucket, "word string, n long, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every word with a form: the end of its chain of forms.

    A form occurs FACTOR times as often as its word, so chains are short; each round doubles the steps
    that all words have gone.
    """
    gone = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = gone.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = salted_left_join(gone, onward, ["root"], "word")
        moved = stored(moved.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("on")), "roots")
        gone = moved.select("word", "root")
        if moved.where("on").isEmpty():
            return gone


def spelling_variants(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    letters: int = LETTERS,
    occurrences: int = OCCURRENCES,
    factor: int = FACTOR,
    slips: int = 0,
) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of all texts, as `word_counts` takes them.

    Words of at least `letters` letters and `occurrences` occurrences. Two are near if they are exactly one
    inserted, deleted or replaced letter apart; n_near counts a word's near words. Its form is the near
    word that occurs most, ties to the smallest in code-point order, if that is `factor` times as often as
    the word itself, else NULL; root is the end of the chain of forms, the word itself without one. An
    empty table, and texts without such words, give no rows. A word has less than 200 near words for each
    of its letters, so groups of near words are small; very long texts are counted in parts, and a very
    long word takes time and memory in proportion to its letters. Other columns are not read.
    """
    counts = word_counts(docs, id_col, text_col, letters, slips)
    vocabulary = stored(counts.where(F.col("n") >= occurrences), "vocabulary")
    pairs = near_pairs(vocabulary, letters)
    best = pairs.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    )
    best = best.select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.near").alias("best"))
    known = vocabulary.join(best, "word", "left")
    has_form = F.col("best_n") >= factor * F.col("n")
    known = stored(
        known.select(
            "word",
            F.when(has_form, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(has_form, F.col("best_n")).alias("form_n"),
        ),
        "variants",
    )
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
