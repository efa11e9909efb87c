"""Removal of lines that stand on many sites: boilerplate, by distinct-site spread.

DataFrame functions only. Each distinct line gets a HyperLogLog sketch of the sites it stands on;
sketches merge by aggregation, so a line found on a third of all pages costs no more than another.
Sketch estimates decide except near the threshold, where the distinct sites are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from punctual.llm.storage import salted_left_join, stored

MIN_SITES = 10
#: log2 of the registers of a sketch; the relative standard error is 1.04 / sqrt(2^10) = 3.3 %.
SKETCH_BITS = 10
#: Estimates within this share of the threshold (over five standard errors) are counted exactly.
NEAR = 0.2


def _lines(docs: DataFrame, text_col: str, site_col: str, id_col: str) -> DataFrame:
    # A row is known by its id and text: 128 bits that are never NULL.
    text, doc = F.col(text_col).cast("string"), F.col(id_col)
    lines = docs.where(text.isNotNull()).select(
        F.xxhash64(doc, text).alias("k1"),
        F.xxhash64(F.lit(1), doc, text).alias("k2"),
        doc.alias("doc"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("")).alias("site"),
        F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"),
    )
    line = F.expr("trim(BOTH ' \t\r' FROM line)")
    lines = lines.withColumns({"h1": F.xxhash64(line), "h2": F.xxhash64(F.lit(1), line), "blank": line == ""})
    return lines.drop("line")


def _boilerplate(lines: DataFrame, min_sites: int) -> DataFrame:
    """(h1, h2, first_doc, first_pos) of every line that stands on at least min_sites sites."""
    sketched = lines.where("not blank").groupBy("h1", "h2").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", SKETCH_BITS)).alias("sites"),
        F.min(F.struct("doc", "pos")).alias("first"),
    )
    spread = stored(sketched.where(F.col("sites") >= (1 - NEAR) * min_sites), "spread-lines")
    near = spread.where(F.col("sites") <= (1 + NEAR) * min_sites).select("h1", "h2", F.lit(True).alias("near"))
    close = salted_left_join(lines.where("not blank").select("h1", "h2", "site", "doc"), near, ["h1", "h2"], "doc")
    counted = close.where("near").select("h1", "h2", "site").distinct().groupBy("h1", "h2").count()
    sure = spread.where(F.col("sites") > (1 + NEAR) * min_sites).select("h1", "h2", "first")
    exact = spread.join(counted.where(F.col("count") >= min_sites), ["h1", "h2"]).select("h1", "h2", "first")
    return sure.unionByName(exact).select(
        "h1", "h2", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos")
    )


def strip_boilerplate(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
) -> DataFrame:
    """(row, text, n_lines, n_removed): the other columns of every input row as a struct, and the rest of its text.

    A line is what stands between newlines, compared without leading and trailing spaces, tabs and
    carriage returns. One that stands on min_sites or more distinct sites is boilerplate: its first
    occurrence, by id and position, stays, all others go. Blank lines are never boilerplate. NULL and the
    empty text are one site. A NULL id comes before all others. A NULL text stays NULL with NULL counts, an
    empty text is one blank line. Repeated rows of one id and text get the same output. An empty table
    gives an empty table; columns are only read through the three names given.
    """
    lines = _lines(docs, text_col, site_col, id_col)
    found = stored(_boilerplate(lines, min_sites), "boilerplate")
    marked = salted_left_join(lines, found.withColumn("hit", F.lit(True)), ["h1", "h2"], "doc")
    first = F.col("doc").eqNullSafe(F.col("first_doc")) & (F.col("pos") == F.col("first_pos"))
    goes = F.coalesce(F.col("hit"), F.lit(False)) & ~F.coalesce(first, F.lit(False)) & ~F.col("blank")
    flags = marked.select("k1", "k2", "pos", goes.alias("goes")).groupBy("k1", "k2")
    flags = flags.agg(F.sort_array(F.collect_set(F.struct("pos", "goes"))).alias("flags"))
    flags = flags.where(F.exists("flags", lambda f: f["goes"]))

    text = F.col(text_col).cast("string")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("row"),
        text.alias("text"),
        F.xxhash64(F.col(id_col), text).alias("k1"),
        F.xxhash64(F.lit(1), F.col(id_col), text).alias("k2"),
    )
    parts = F.split("text", "\n", -1)
    kept = F.array_join(F.filter(parts, lambda x, i: ~F.col("flags")[i]["goes"]), "\n")
    gone = F.size(F.filter("flags", lambda f: f["goes"])).cast("long")
    whole = F.col("text").isNull() | F.col("flags").isNull()
    return keyed.join(flags, ["k1", "k2"], "left").select(
        "row",
        F.when(whole, F.col("text")).otherwise(kept).alias("text"),
        F.when(F.col("text").isNotNull(), F.size(parts)).cast("long").alias("n_lines"),
        F.when(F.col("text").isNotNull(), F.when(F.col("flags").isNull(), F.lit(0)).otherwise(gone))
        .cast("long")
        .alias("n_removed"),
    )


def remove_boilerplate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """(id, text, n_lines, n_removed) of strip_boilerplate."""
    out = strip_boilerplate(docs, id_col, text_col, **how)
    return out.select(F.col("row")[id_col].alias(id_col), "text", "n_lines", "n_removed")
