"""Readers: tables, text directories, frequency files, indexes, JDBC, configuration."""

from __future__ import annotations

import atexit
import hashlib
import json
import shutil
import tempfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import FREQUENCIES, INDEX_DOCS, POSTINGS


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Columns of one parquet table; only these are read."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def text_directory(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """(path, size, text): every file of one directory with exactly this suffix, one row each; not recursive.

    Empty files are rows too. Bytes that are not UTF-8 become replacement characters.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", False).load(path)
    full = files.select("path", F.col("length").alias("size"), F.make_valid_utf8(F.col("content").cast("string")).alias("text"))
    empty = _empty_files(spark, path, suffix)
    return full.unionAll(spark.createDataFrame([(p, 0, "") for p in empty], full.schema)) if empty else full


def _empty_files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Files without a byte, which Spark's file sources leave out; only names are listed."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)
    return [str(f.getPath()) for f in listed if f.isFile() and f.getLen() == 0 and f.getPath().getName().endswith(suffix)]


def numbered_documents(files: DataFrame) -> DataFrame:
    """doc_id from names such as ``doc_17.txt``: the number is the stable id of the source table."""
    number = F.regexp_extract("path", r"(\d+)\.[^./]*$", 1)
    return files.select(F.when(number != "", number.cast("long")).alias("doc_id"), "text")


def frequency_csv(spark: SparkSession, path: str) -> DataFrame:
    """word, frequency from a CSV with header, in UTF-8.

    Where a word is not UTF-8 - it then holds a replacement character - all is read as windows-1251. No row is dropped: what is not a number is null.
    """
    read = lambda encoding: spark.read.csv(path, header=True, schema=FREQUENCIES, mode="PERMISSIVE", encoding=encoding)
    frequencies = read("UTF-8")
    broken = frequencies.where(F.contains("word", F.lit("\ufffd"))).limit(1).count()
    if not broken:
        return frequencies
    # Every byte is a character of Latin-1, whose upper half then stands for the same bytes of windows-1251.
    upper = bytes(range(0x80, 0x100))
    return read("ISO-8859-1").withColumn("word", F.translate("word", upper.decode("latin-1"), upper.decode("cp1251", "replace")))


_HOMES: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder for tables that several queries read: ``spark.checkpoint.dir``, or on a local master a temporary one."""
    sc = spark.sparkContext
    home = sc.getConf().get("spark.checkpoint.dir") or _HOMES.get(sc.applicationId)
    if not home:
        if not sc.master.startswith("local") or "cluster" in sc.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        home = _HOMES[sc.applicationId] = tempfile.mkdtemp(prefix="quillspan-")
        atexit.register(shutil.rmtree, home, ignore_errors=True)
    return home


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the shared folder; partitions and the order of their rows are fixed from then on."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, sizes and times of the files of a table; it changes when the table is rewritten. Only the listing is read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
    seen = []
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing reads any more, through Hadoop's file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


@dataclass
class Index:
    """A stored index: one row per document, one row per (term, document)."""

    docs: DataFrame
    postings: DataFrame


def load_index(spark: SparkSession, path: str) -> Index:
    """Open an index that ``write_index`` wrote; a missing one raises with its path."""
    from pyspark.errors import AnalysisException

    try:
        docs = spark.read.schema(INDEX_DOCS).parquet(f"{path}/docs")
        postings = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    except AnalysisException as error:
        raise FileNotFoundError(f"no index at {path}") from error
    return Index(docs, postings)


def raw_documents_jdbc(spark: SparkSession, url: str, table_name: str = "documents", fetch: int = 1000, parts: int = 16, bounds: tuple[int, int] | None = None) -> DataFrame:
    """The raw document table over JDBC: four columns, read in ranges of id, fetched in batches."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table_name).option("fetchsize", fetch)
    if bounds:
        reader = reader.option("partitionColumn", "id").option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load().select("id", "url", "source_name", "raw_html")


def query_lines(lines: list[str]) -> list[str]:
    """Queries from lines of input: blank lines are skipped, ``exit`` ends the input."""
    queries = []
    for line in lines:
        line = line.rstrip("\n")
        if line == "exit":
            break
        if line:
            queries.append(line)
    return queries


@dataclass
class CrawlSource:
    name: str
    start_url: str = ""
    link_selector: str = ""
    next_selector: str = ""
    max_pages: int = 1


@dataclass
class CrawlConfig:
    db: dict = field(default_factory=dict)
    logic: dict = field(default_factory=dict)
    sources: list[CrawlSource] = field(default_factory=list)


def read_config(path: str) -> CrawlConfig:
    """Crawl configuration from JSON, or from YAML where a YAML library is installed."""
    raw = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(raw)
    else:
        data = json.loads(raw)
    known = CrawlSource.__dataclass_fields__
    sources = [CrawlSource(**{k: v for k, v in s.items() if k in known}) for s in data.get("sources", [])]
    return CrawlConfig(data.get("db", {}), data.get("logic", {}), sources)
