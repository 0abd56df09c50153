"""Tokens: separators, case folding, titles. Everything stays in Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters that end a token.
SEPARATORS = " \t\n\r.,!?:;\"'()[]{}-<>/|\\*&^%$#@~`="
#: The same set as a regular expression that Java and RE2 read alike.
SEPARATOR_PATTERN = r"""[ \t\n\r.,!?:;"'()\[\]{}\-<>/|\\*&\^%$#@~`=]+"""

_LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_CYRILLIC = "".join(map(chr, range(ord("А"), ord("Я") + 1)))
#: Letters that fold in each mode. ``reference`` leaves the second half of the Cyrillic capitals as it is.
FOLDED = {"reference": _LATIN + _CYRILLIC[:16] + "Ё", "cyrillic": _LATIN + _CYRILLIC + "Ё"}

NO_TITLE = "No Title"


def fold(text: Column | str, mode: str = "reference") -> Column:
    """Case folding of a fixed set of letters; all other characters stay."""
    return F.translate(F.col(text) if isinstance(text, str) else text, FOLDED[mode], FOLDED[mode].lower())


def fold_word(word: str, mode: str = "reference") -> str:
    """``fold`` for a query term on the driver."""
    return word.translate(str.maketrans(FOLDED[mode], FOLDED[mode].lower()))


def token_array(text: Column | str, mode: str = "reference") -> Column:
    """Folded tokens of a text in order; a null text has none."""
    parts = F.split(fold(text, mode), SEPARATOR_PATTERN)
    return F.coalesce(F.filter(parts, lambda t: t != ""), F.array().cast("array<string>"))


def title(text: Column | str = "text") -> Column:
    """First line without one trailing carriage return; an empty document has a fixed title."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.coalesce(text, F.lit("")) == "", F.lit(NO_TITLE)).otherwise(F.regexp_replace(F.substring_index(text, "\n", 1), r"\r\z", ""))


#: Largest table that is dealt out anew, bytes that a task should have at least, and most files whose footers are read.
SPREAD_BYTES = 256 << 20
TASK_BYTES = 1 << 20
FOOTERS = 32


def _row_groups(df: DataFrame) -> tuple[int, int] | None:
    """(row groups, their uncompressed bytes) of the parquet files behind a frame; None if they are no parquet files or too many."""
    files = df.inputFiles()
    if not files or len(files) > FOOTERS or not all(f.endswith(".parquet") for f in files):
        return None
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    groups = size = 0
    for f in files:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)), conf))
        try:
            rows = reader.getRowGroups()
            groups, size = groups + rows.size(), size + sum(rows.get(k).getTotalByteSize() for k in range(rows.size()))
        finally:
            reader.close()
    return groups, size


#: Bytes of one batch of rows that a Python worker gets.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound what a Python worker gets at once by bytes and not by rows alone, so that its memory does not follow the length of texts.

    The bound stays set: results are planned when the caller reads them.
    """
    known = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    if int(str(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(known))) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", f"{BATCH_BYTES}b")


def plan_bytes(df: DataFrame) -> int:
    """Size of a frame by the planner's estimate."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small table in few splits out to more tasks; larger tables stay as they are split.

    The planner's size estimate decides, so no table beyond ``SPREAD_BYTES`` is ever shuffled, however
    many cores there are. A split that begins no row group of its file reads nothing, so a table has no more
    splits than row groups, whose footers also tell its size before compression.
    """
    size = plan_bytes(df)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if size > SPREAD_BYTES or cores < 2:
        return df
    splits = df.rdd.getNumPartitions()
    if splits < 2 * cores and (known := _row_groups(df)):
        splits, size = min(splits, known[0]), max(size, known[1])
    tasks = min(cores, size // TASK_BYTES)
    return df.repartition(tasks) if splits * 2 <= tasks else df
