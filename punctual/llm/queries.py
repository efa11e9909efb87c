"""Registered queries of the training-data operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from punctual.llm import idfiles, lines, minhash, packing, passages, periodic, pieces, pivots, postings, quality, repeats, spelling, warczip
from punctual.llm.storage import ship, table

#: Vocabulary files; every operator takes its path as a parameter.
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECE_VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]


def op1_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of embeddings of one label at cosine 0.98."""
    return pivots.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of documents on 2-word shingles at similarity 0.8."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2)


def op3_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the lines that stand on ten sources or more."""
    return lines.remove_boilerplate(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    scored = quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select(F.col("row.doc_id").alias("doc_id"), "held_out", "score", "predicted")


def op5_warczip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC records in ZIP packages and read back from them."""
    return warczip.archive_round_trip(spark, table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents packed into sequences of 2048 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_VOCABULARY)


def op7_idfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids, written to coded files and read back from them."""
    return idfiles.id_file_round_trip(spark, table(spark, sf_dir, "documents"), WORD_VOCABULARY)


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' ids by best segmentation into pieces, and whether they decode to the text."""
    return pieces.encode_pieces(table(spark, sf_dir, "documents"), PIECE_VOCABULARY)


def op9_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 embeddings of largest inner product with each whose id is a multiple of 20."""
    rows = table(spark, sf_dir, "embeddings")
    return postings.nearest_neighbours(rows, rows.where("vec_id % 20 = 0"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the paragraphs that stand in earlier ones."""
    return passages.remove_repeated_passages(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents with their near words, forms and roots; one occurrence of 199 has a letter less."""
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), slips=199)


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that stand anywhere else too."""
    left = repeats.strip_repeats(table(spark, sf_dir, "documents"))
    spans = F.size("removed").cast("long").alias("n_spans")
    return left.select("doc_id", "n_bytes", "n_removed", spans, "kept_sha256")


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text; in one document of ten, chosen by its id, the words from one on repeat the next p."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def planted(w):
        n, g = F.size(w).cast("long"), F.floor(h / 10).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8)))).cast("long")

        def word(i):
            return F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int"))

        moved = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), word)
        return F.when(n > 0, F.array_join(moved, " "))

    # The words are bound once: as a plain column they would be split anew for every place.
    text = F.when(F.pmod(h, F.lit(10)) == 0, F.transform(F.array(words), planted)[0]).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words of every document, and digests of them and of what is left without the repeats."""
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    ranked = F.array_sort("runs", periodic.larger_exponent_first)
    top = F.get(ranked, F.lit(0))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("(1000 * top.length) div top.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda r: F.concat(r, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Query] = {
    "op1_pivots": op1_pivots,
    "op2_minhash": op2_minhash,
    "op3_lines": op3_lines,
    "op4_quality": op4_quality,
    "op5_warczip": op5_warczip,
    "op6_packing": op6_packing,
    "op7_idfiles": op7_idfiles,
    "op8_pieces": op8_pieces,
    "op9_postings": op9_postings,
    "op10_passages": op10_passages,
    "op11_spelling": op11_spelling,
    "op12_repeats": op12_repeats,
    "op13_periodic": op13_periodic,
}
ORACLES: dict[str, str] = {
    "op3_lines": """
WITH d AS (SELECT doc_id, coalesce(source, '') AS site, string_split(text, chr(10)) AS ls FROM documents
           WHERE text IS NOT NULL),
l AS (SELECT doc_id, site, i AS pos, ls[i + 1] AS line, trim(ls[i + 1], ' ' || chr(9) || chr(13)) AS norm
      FROM d, unnest(range(len(ls))) AS t(i)),
g AS (SELECT norm, min((doc_id, pos)) AS first FROM l WHERE norm <> ''
      GROUP BY norm HAVING count(DISTINCT site) >= 10),
m AS (SELECT l.*, g.norm IS NOT NULL AND (l.doc_id, l.pos) <> g.first AS goes FROM l LEFT JOIN g USING (norm)),
r AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '') AS text,
             count(*) AS n_lines, count(*) FILTER (goes) AS n_removed FROM m GROUP BY doc_id)
SELECT doc_id, r.text, r.n_lines, r.n_removed FROM documents LEFT JOIN r USING (doc_id)
""",
}


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    run.__doc__ = query.__doc__
    return run


def all_queries() -> dict[str, Query]:
    return {name: _shipped(query) for name, query in QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
