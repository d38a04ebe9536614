"""Exact deduplication of texts by salted digest groups that compare whole contents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.llm.common import ascii_lower, free_name, whole_text
from holdfast.session import cut_lineage

#: Parts that the copies of one text are dealt over before they are merged; at most 63, as a group's
#: parts are kept as the bits of one long.
SALTS = 32


def sha256_key(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _salted(docs: DataFrame, id_col: str, text_col: str, salts: int, digest) -> DataFrame:
    salt = F.pmod(F.xxhash64(F.col("id"), F.lit(17)), F.lit(salts)).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), ascii_lower(whole_text(text_col)).alias("body"))
    return rows.select("id", "body", digest(F.col("body")).alias("digest"), salt.alias("salt"))


def _labels(rows: DataFrame) -> DataFrame:
    """One written row per distinct text: its digest, the id that stays, its size and its salts."""
    parts = rows.groupBy("digest", "body", "salt").agg(F.max("id").alias("top"), F.count("*").alias("n"))
    bit = F.expr("shiftleft(1L, salt)")
    # Dealt by digest alone, so that the number of contents of a digest needs no further exchange.
    groups = parts.repartition("digest").groupBy("digest", "body").agg(
        F.max("top").alias("keep_id"), F.sum("n").alias("group_size"), F.bit_or(bit).alias("salts")
    )
    contents = F.count("*").over(Window.partitionBy("digest"))
    labels = groups.select("*", (contents > 1).alias("several"), F.sha2("body", 256).alias("text_sha256"))
    return cut_lineage(labels.withColumn("body", F.when(F.col("several"), F.col("body"))), "labels")


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = SALTS,
    digest: Callable[[Column], Column] = sha256_key,
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The largest id of
    a group stays. Three merges, each by digest AND whole content, so a digest collision never joins
    two texts: the map-side aggregate of every task, the salted groups (a text that fills a third of
    the table is dealt over `salts` tasks), and the salt winners, at most `salts` per text. Documents
    find their group by (digest, salt) without their text; where a digest turns out to have several
    contents, those documents compare content there too.

    Null ids take part, as the smallest; a group of nulls only has keep_id null. Rows repeated with
    the same id and text each give a row, of which exactly one is kept. Other columns are ignored.
    An empty table gives an empty result.
    """
    rows = _salted(docs, id_col, text_col, salts, digest)
    labels = _labels(rows)
    own = F.expr(f"filter(sequence(0, {salts - 1}), x -> getbit(salts, x) = 1)")
    spread = labels.withColumn("salt", F.explode(own))
    told = ["keep_id", "group_size", "text_sha256"]
    found = rows.groupBy("id", "digest", "salt").agg(F.count("*").alias("times"))
    found = found.join(spread.filter("not several").select("digest", "salt", *told), ["digest", "salt"])
    if not labels.filter("several").isEmpty():
        again = rows.groupBy("id", "digest", "salt", "body").agg(F.count("*").alias("times"))
        again = again.join(spread.filter("several").select("digest", "salt", "body", *told), ["digest", "salt", "body"])
        found = found.unionByName(again.select(found.columns))
    copies = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    kept = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return copies.select(
        F.col("id").alias(id_col), "keep_id", F.col("group_size").cast("long"), kept.alias("kept"), "text_sha256"
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The table with one row per distinct text, the one `exact_groups` keeps; all columns come back.

    Rows are chosen by (id, digest) after the content-comparing merges, so the table is shuffled once
    more, by a key of its own for every document. Null, empty and repeated rows as in `exact_groups`.
    """
    labels = _labels(_salted(docs, id_col, text_col, salts, sha256_key))
    key, stays, turn = (free_name(docs, c) for c in ("_digest", "_stays", "_turn"))
    wanted = labels.select(F.col("digest").alias(key), F.col("keep_id").alias(stays))
    rows = docs.withColumn(key, sha256_key(ascii_lower(whole_text(text_col))))
    same = (rows[id_col].eqNullSafe(wanted[stays])) & (rows[key] == wanted[key])
    rows = rows.join(wanted, same, "left_semi")
    first = F.row_number().over(Window.partitionBy(id_col, key).orderBy(F.lit(1)))
    return rows.withColumn(turn, first).filter(F.col(turn) == 1).select(*docs.columns)
