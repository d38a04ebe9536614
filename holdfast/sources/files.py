"""Reading delimited text of unknown encoding and separator; writing tables as CSV."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SEPARATORS = [",", ";", "\t", "|"]


def sniff(spark: SparkSession, path: str, encoding: str | None = None) -> tuple[str, str, bool]:
    """(encoding, separator, has byte-order mark).

    The separator comes from the header line. UTF-8 is believed only when every line is valid, which
    is one distributed pass over the text; naming the encoding skips it.
    """
    text = spark.read.text(path)
    header = text.limit(1).collect()
    first = header[0]["value"] if header else ""
    separator = max(SEPARATORS, key=first.count)
    if encoding is None:
        valid = text.agg(F.every(F.is_valid_utf8("value"))).first()[0]
        encoding = "ISO-8859-1" if valid is False else "UTF-8"
    return encoding, separator if first.count(separator) else ",", first.startswith("\ufeff")


def read_csv_any(
    spark: SparkSession,
    path: str,
    schema: StructType | str | None = None,
    encoding: str | None = None,
) -> DataFrame:
    """CSV with the encoding and separator found by looking at it.

    Without a schema the types are inferred, which reads the data twice: give one for large files.
    """
    found, separator, marked = sniff(spark, path, encoding)
    reader = (
        spark.read.option("header", True)
        .option("sep", separator)
        .option("encoding", found)
        .option("mode", "PERMISSIVE")
    )
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if marked:
        df = df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("\ufeff").strip('"'))
    return df


# ---- folders of mixed files ----------------------------------------------------------------------

HEAD_BYTES = 65_536
HEADS_AT_ONCE = 16


@dataclass
class FolderRead:
    """Rows of all files, and the files of each kind of header."""

    rows: DataFrame
    kinds: dict[tuple[str, str], list[str]]  # (header, separator) -> files


def first_lines(spark: SparkSession, paths: list[str]) -> list[str]:
    """The first line of every file, by the file systems that Spark reads them with: one short read each."""
    conf, jvm = spark._jsc.hadoopConfiguration(), spark._jvm

    def head(path: str) -> str:
        where = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(path))
        opened = jvm.org.apache.spark.sql.execution.datasources.CodecStreams.createInputStream(conf, where)
        try:
            raw = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(
                jvm.org.apache.commons.io.input.BoundedInputStream(opened, HEAD_BYTES)))
        finally:
            opened.close()
        line = raw.splitlines()[0] if raw else b""
        try:
            return line.decode()
        except UnicodeDecodeError:
            return line.decode("iso-8859-1")

    with ThreadPoolExecutor(HEADS_AT_ONCE) as pool:
        return list(pool.map(head, paths))


def separator_of(header: str) -> str:
    best = max(SEPARATORS, key=header.count)
    return best if header.count(best) else ","


def read_csv_folder(
    spark: SparkSession, path: str, schema: StructType | str | None = None, mark: str | None = None
) -> FolderRead:
    """CSV files whose headers, separators and encodings differ from file to file, in one pass.

    The header of each file names its columns and its separator. Every line is read as UTF-8 if it is
    valid, else as ISO-8859-1; `mark` names a column that tells which lines these were, so the pass that
    uses the rows can count them. Columns are matched by name and are strings unless `schema` names types; a file without a column gives nulls. A line equal to
    its file's header is no row. Quoted line ends are not supported, as files are split anywhere.
    """
    text = spark.read.text(path)
    names = sorted(text.inputFiles())
    kinds: dict[tuple[str, str], list[str]] = {}
    for name, header in zip(names, first_lines(spark, names)):
        header = header.rstrip("\r\n")
        if header.strip("\ufeff \t"):
            kinds.setdefault((header, separator_of(header)), []).append(name)
    wanted = _fields(schema)
    parts = []
    for (header, separator), own in kinds.items():
        parts.append(_one_kind(spark, own, header, separator, wanted))
    if not parts:
        rows = spark.createDataFrame([], wanted or StructType([])).withColumn("_other", F.lit(False))
    else:
        rows = parts[0]
        for more in parts[1:]:
            rows = rows.unionByName(more, allowMissingColumns=True)
    if wanted is not None:
        rows = rows.select(*[F.col(f"`{f.name}`") if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted], "_other")
    return FolderRead(rows.withColumnRenamed("_other", mark) if mark else rows.drop("_other"), kinds)


def _fields(schema: StructType | str | None) -> StructType | None:
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _one_kind(spark: SparkSession, paths: list[str], header: str, separator: str, wanted: StructType | None) -> DataFrame:
    names = [n.strip().strip('"') for n in header.lstrip("\ufeff").split(separator)]
    types = {f.name: f.dataType.simpleString() for f in wanted} if wanted is not None else {}
    ddl = ", ".join(f"`{n.replace('`', '``')}` {types.get(n, 'string')}" for n in names)
    raw = F.col("value")
    valid = F.is_valid_utf8(raw)
    line = F.when(valid, raw).otherwise(F.decode(raw.cast("binary"), "ISO-8859-1"))
    lines = spark.read.text(paths).select(F.regexp_replace(line, "\r$", "").alias("line"), (~valid).alias("_other"))
    lines = lines.where(~F.col("line").isin(header, header.lstrip("\ufeff"), ""))
    parsed = lines.select(F.from_csv("line", F.lit(ddl), {"sep": separator}).alias("r"), "_other")
    return parsed.select("r.*", "_other")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header and empty nulls, one file per partition."""
    df.write.option("header", True).option("nullValue", "").option("emptyValue", "").mode(
        "overwrite"
    ).csv(path)
