"""Ids of texts that hold an added token's string, against the library as it is."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from punctual.llm import idfiles, packing, queries, tokens
from punctual.llm.storage import new_folder

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z <|startoftext|>", "<|endoftext", "<|EndOfText|> é", "plain text", "", None]


@pytest.mark.parametrize("path, spaces", [(queries.BYTE_VOCABULARY, True), (queries.WORD_VOCABULARY, False)])
def test_ids_are_those_of_the_unchanged_library(path, spaces):
    own, library = tokens.encoder(path, spaces), Tokenizer.from_file(path)
    for _ in range(2):
        ids, bounds = own.encode(TEXTS)
        for i, text in enumerate(TEXTS):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_operators_give_these_ids(spark):
    table = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")

    def checksums(path):
        library = Tokenizer.from_file(path)
        ids = [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in TEXTS]
        return {i: zlib.crc32(np.array(x, "<u4").tobytes()) for i, x in enumerate(ids)}

    packed = packing.pack_documents(table, queries.BYTE_VOCABULARY).collect()
    assert {r.doc_id: r.ids_crc32 for r in packed} == checksums(queries.BYTE_VOCABULARY)
    read = idfiles.read_ids(idfiles.write_ids(table, new_folder(spark, "test-ids"), queries.WORD_VOCABULARY)).collect()
    assert {r.doc_id: r.ids_crc32 for r in read} == checksums(queries.WORD_VOCABULARY)
