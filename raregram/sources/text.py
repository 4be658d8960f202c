"""Sources and sinks of text columns: lines in the text format of bulk loads, and Parquet."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The escapes of the text format of bulk loads.
ESCAPES = {"b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v"}
NULL = "\\N"
#: A stretch of plain text, or an escape: of a byte by two hexadecimal or three octal digits, or of one character.
PIECE = r"(?s)[^\\]+|\\x[0-9A-Fa-f]{1,2}|\\[0-7]{1,3}|\\."


def decode(line: Column) -> Column:
    """The value of a one-column line: ``\\N`` is null, a backslash makes the next character literal, a control, or a byte by its digits."""
    pieces = F.regexp_extract_all(line, F.lit(PIECE), F.lit(0))
    named = F.create_map(*[F.lit(x) for c, v in ESCAPES.items() for x in (c, v)])

    def data(p: Column) -> Column:
        """The piece's bytes in hexadecimal: bytes of a character may be given one by one."""
        code = F.when(p.rlike(r"^\\x[0-9A-Fa-f]"), F.conv(F.substring(p, 3, 2), 16, 10)).when(p.rlike(r"^\\[0-7]"), F.conv(F.substring(p, 2, 3), 8, 10)).cast("int")
        char = F.substring(p, 2, 1)
        text = F.when(~p.startswith("\\"), p).otherwise(F.coalesce(named[char], char))
        return F.when(code.isNotNull(), F.lpad(F.hex(code % 256), 2, "0")).otherwise(F.hex(F.encode(text, "UTF-8")))

    body = F.decode(F.unhex(F.array_join(F.transform(pieces, data), "")), "UTF-8")
    return F.when(line == NULL, F.lit(None)).when(F.instr(line, "\\") == 0, line).otherwise(body)


def encode(text: Column) -> Column:
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c, v in ESCAPES.items():
        body = F.replace(body, F.lit(v), F.lit("\\" + c))
    return F.coalesce(body, F.lit(NULL))


def text_lines(spark: SparkSession, path: str, column: str = "s", encoded: bool = True) -> DataFrame:
    """One row for each line."""
    lines = spark.read.text(path)
    return lines.select((decode(F.col("value")) if encoded else F.col("value")).alias(column))


def write_lines(df: DataFrame, path: str, column: str = "s") -> None:
    df.select(encode(F.col(column)).alias("value")).write.mode("overwrite").text(path)


def spread(df: DataFrame) -> DataFrame:
    """A table read from fewer splits than half of the cores, as one small file is, dealt over all of them; any other as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if 2 * df.rdd.getNumPartitions() <= cores else df


def scratch_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: ``spark.checkpoint.dir``, or one of our own on a single machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="raregram-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def parquet_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
