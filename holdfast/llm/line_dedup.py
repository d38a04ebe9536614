"""Line deduplication across documents; the result is one compressed keep bitmap per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import ascii_lower, free_name, whole_text
from holdfast.session import cut_lineage, shuffle_width

BLANKS = " \t\n\x0b\x0c\r"
#: Lines of fewer code points are never dropped; a line must be in so many documents to be dropped.
MIN_CHARS, MIN_DOCS = 40, 5
#: Parts that the documents holding one line are dealt over.
SALTS = 16


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _row_of(id_col: str, text_col: str) -> list[Column]:
    """What tells rows apart: the id (null as the smallest) and, for a repeated id, a text digest."""
    return [
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("line_doc"),
        F.xxhash64(whole_text(text_col)).alias("line_row"),
    ]


def dropped_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS, salts: int = SALTS,
) -> DataFrame:
    """(line_doc, line_row, dropped): sorted positions of the dropped lines of a row that loses any.

    Line digests are written once, range-partitioned by (digest, salt) with documents in falling and
    positions in rising order, and streamed: the first row of a digest names the largest document,
    and the first row of each document adds one to the count. The salt follows the document, so the
    counts of a line in a third of all documents add up over `salts` ranges.
    """
    rows = docs.select(*_row_of(id_col, text_col), split_lines(whole_text(text_col)).alias("lines"))
    lines = rows.select("line_doc", "line_row", F.posexplode("lines").alias("pos", "line"))
    lines = lines.select("line_doc", "line_row", "pos", line_key(F.col("line")).alias("key"))
    lines = lines.filter(F.char_length("key") >= min_chars)
    salt = F.pmod(F.xxhash64("line_doc"), F.lit(salts)).cast("int")
    lines = lines.select(F.unhex(F.md5("key")).alias("digest"), salt.alias("salt"), "line_doc", "line_row", "pos")
    lines = cut_lineage(lines, "lines")

    laid = lines.repartitionByRange(shuffle_width(docs.sparkSession), "digest", "salt")
    stream = Window.partitionBy("digest", "salt").orderBy(F.desc("line_doc"), "line_row", "pos")
    first = (~F.col("line_doc").eqNullSafe(F.lag("line_doc").over(stream))).cast("long")
    firsts = laid.select("digest", "salt", "line_doc", first.alias("first"))
    parts = firsts.groupBy("digest", "salt").agg(F.max("line_doc").alias("top"), F.sum("first").alias("n"))
    common = parts.groupBy("digest").agg(F.max("top").alias("holder"), F.sum("n").alias("n"))
    common = common.filter(F.col("n") >= min_docs).select("digest", "holder")
    common = common.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    lost = lines.join(common, ["digest", "salt"]).filter("line_doc <> holder")
    lost = lost.groupBy("line_doc", "line_row").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    return lost


def keep_runs(n_lines: Column, dropped: Column) -> Column:
    """Run-length bitmap of the lines: (start, length) of every run of kept lines."""
    edges = F.concat(F.array(F.lit(-1)), dropped, F.array(n_lines))
    runs = F.transform(
        F.sequence(F.lit(1), F.size(edges) - 1),
        lambda i: F.struct(
            (F.get(edges, i - 1) + 1).alias("start"), (F.get(edges, i) - F.get(edges, i - 1) - 1).alias("length")
        ),
    )
    return F.filter(runs, lambda r: r["length"] > 0)


def apply_runs(lines: Column, runs: Column) -> Column:
    kept = F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["length"])))
    return F.array_join(kept, "\n")


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, **how) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, keep_runs; with keep_text also kept_text.

    A line's key is the line without blanks at its ends, A-Z lower-cased. A key of at least
    `min_chars` code points in at least `min_docs` documents loses all its lines except in the
    largest id that holds it. A null or empty text is one empty line. Rows that share an id count as
    one document; each gives a row of its own. Null ids count as one document, the smallest.
    """
    lost = dropped_lines(docs, id_col, text_col, **how)
    lines = split_lines(F.col("body"))
    rows = docs.select(F.col(id_col).alias("own_id"), *_row_of(id_col, text_col), whole_text(text_col).alias("body"))
    if not keep_text:
        rows = rows.select("own_id", "line_doc", "line_row", F.size(lines).alias("n_lines"))
    rows = rows.join(lost, ["line_doc", "line_row"], "left")
    n = F.size(lines) if keep_text else F.col("n_lines")
    dropped = F.coalesce(F.col("dropped"), F.array().cast("array<int>"))
    out = [F.col("own_id").alias(id_col), n.cast("long").alias("n_lines"), F.size(dropped).cast("long").alias("n_dropped"),
           keep_runs(n, dropped).alias("keep_runs")]
    if keep_text:
        whole = F.when(F.col("dropped").isNull(), F.col("body"))
        out.append(whole.otherwise(apply_runs(lines, keep_runs(n, dropped))).alias("kept_text"))
    return rows.select(*out)


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The table with the text of every row reduced to its kept lines; null texts stay null."""
    lost = dropped_lines(docs, id_col, text_col, **how)
    doc, row, gone = (free_name(docs, c) for c in ("_line_doc", "_line_row", "_dropped"))
    lost = lost.select(F.col("line_doc").alias(doc), F.col("line_row").alias(row), F.col("dropped").alias(gone))
    own, mark = _row_of(id_col, text_col)
    rows = docs.withColumns({doc: own, row: mark}).join(lost, [doc, row], "left")
    lines = split_lines(F.col(text_col))
    kept = apply_runs(lines, keep_runs(F.size(lines), F.col(gone)))
    text = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(kept).alias(text_col)
    return rows.select(*[text if c == text_col else F.col(c) for c in docs.columns])
