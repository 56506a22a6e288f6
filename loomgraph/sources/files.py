"""Files as a table: recursive listing, hashing, decoding; unreadable files are rejects, not failures."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.config import FORMATS
from loomgraph.functions.text import relative_path, suffix
from loomgraph.sources.pdf import pdf_text


#: Tasks that files are read by at most, for each partition of a shuffle.
FILE_TASKS = 8


class Loaders:
    """Parsers of binary formats by suffix: bytes to text. Text formats need none."""

    def __init__(self) -> None:
        self.parsers: dict[str, Callable[[bytes], str]] = {".docx": docx_text, ".pdf": pdf_text}

    def register(self, ending: str, parse: Callable[[bytes], str]) -> Loaders:
        self.parsers[ending.lower()] = parse
        return self


def docx_text(content: bytes) -> str:
    """Paragraphs of a Word document joined by blank lines, without empty ones."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        xml = z.read("word/document.xml").decode("utf-8")
    lines = ("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p)) for p in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S))
    unescape = lambda x: x.replace("&lt;", "<").replace("&gt;", ">").replace("&quot;", '"').replace("&amp;", "&")
    return "\n\n".join(unescape(x) for x in lines if x.strip())


def scan(spark: SparkSession, raw_dir: str, formats: tuple[str, ...] = FORMATS) -> DataFrame:
    """path (below raw_dir), content, sha256 and suffix of every supported file, at any depth."""
    if not exists(spark, raw_dir):
        return spark.createDataFrame([], "path string, content binary, sha256 string, suffix string, size long, modified timestamp")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(raw_dir)
    root = _qualified(spark, raw_dir)
    # the name comes from the files' metadata, so that filters on it, here and in load, leave out files before they are opened
    name = F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))
    rows = raw.withColumn("suffix", suffix(name)).filter(F.col("suffix").isin(*formats))
    # Spark makes a task of some thirty small files
    rows = rows.coalesce(FILE_TASKS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    columns = ["path", "content", "suffix", F.col("length").alias("size"), F.col("modificationTime").alias("modified")]
    every = rows.select(*columns).unionByName(_empty(raw).withColumn("suffix", suffix(F.col("path"))).filter(F.col("suffix").isin(*formats)).select(*columns))
    return every.select(relative_path(local("path"), root).alias("path"), "content", F.sha2("content", 256).alias("sha256"), "suffix", "size", "modified")


def local(uri: str) -> Column:
    """Local files are named in one of two ways."""
    return F.regexp_replace(uri, "^file:/+", "file:///")


def _empty(raw: DataFrame) -> DataFrame:
    """The files without a byte in a folder read as binaryFile: Spark lists them but never makes rows of them."""
    spark, jvm, names = raw.sparkSession, raw.sparkSession._jvm, raw._jdf.inputFiles()
    objects = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, len(names))  # names stay in the JVM: one by one they take minutes to reach Python
    jvm.java.lang.System.arraycopy(names, 0, objects, 0, len(names))
    listed = spark._jsparkSession.createDataset(jvm.java.util.Arrays.asList(objects), jvm.org.apache.spark.sql.Encoders.STRING())
    listed = DataFrame(listed.toDF(), spark).select(local("value").alias("at"))
    read = raw.select(local("_metadata.file_path").alias("at")).coalesce(FILE_TASKS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    path = F.url_decode(F.replace("at", F.lit("+"), F.lit("%2B")))
    return listed.join(read, "at", "left_anti").select(path.alias("path"), F.lit(b"").alias("content"), F.lit(0).cast("long").alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))


def write_texts(rows: DataFrame, folder: str) -> int:
    """Write rows (path, text) as UTF-8 files below a folder that all executors share; the number of files. A null text is empty."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        at, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
        made: set[str] = set()
        for frame in frames:
            for path, text in zip(frame["path"], frame["text"], strict=True):
                above, name = f"{root}/{path}".rsplit("/", 1)
                if above not in made:
                    at.create_dir(above, recursive=True)
                    made.add(above)
                with at.open_output_stream(f"{above}/{name}", compression=None) as out:
                    out.write((text or "").encode())
            yield pd.DataFrame({"n": [len(frame)]})

    return rows.select("path", "text").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _qualified(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return re.sub("^file:/+", "file:///", full)


def load(files: DataFrame, loaders: Loaders | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects): path, sha256, suffix, format and text; or path and reason.

    Text and code files must be valid UTF-8; other formats need a parser.
    """
    parsers = (loaders or Loaders()).parsers
    plain = files.filter(~F.col("suffix").isin(".pdf", ".docx", *parsers))
    good = F.is_valid_utf8(F.col("content"))
    text = plain.filter(good).withColumn("text", F.decode("content", "UTF-8"))
    bad = plain.filter(~good).select("path", F.lit("not valid UTF-8").alias("reason"))
    binary = files.filter(F.col("suffix").isin(".pdf", ".docx", *parsers))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, reasons = [], []
            for ending, content in zip(frame["suffix"], frame["content"], strict=True):
                try:
                    texts.append(parsers[ending](bytes(content)))
                    reasons.append(None)
                except KeyError:
                    texts.append(None)
                    reasons.append(f"no parser for {ending}")
                except Exception as e:  # a broken file must not stop the build
                    texts.append(None)
                    reasons.append(f"{type(e).__name__}: {e}")
            yield frame.drop(columns="content").assign(text=texts, reason=reasons)

    parsed = binary.select("path", "sha256", "suffix", "content").mapInPandas(run, "path string, sha256 string, suffix string, text string, reason string")
    columns = ["path", "sha256", "suffix", F.expr("substr(suffix, 2)").alias("format"), "text"]
    documents = text.select(*columns).unionByName(parsed.filter("reason is null").select(*columns))
    return documents, bad.unionByName(parsed.filter("reason is not null").select("path", "reason"))
