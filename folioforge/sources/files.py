"""Readers of corpora, indexes and raw files."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = "id string, codebookId string, sourcePath string, startLine int, endLine int, content string, embedding array<double>, meta map<string,string>"


def corpus_id(name: str, aliases: dict[str, str] | None = None) -> str:
    """Trimmed, lower-cased, aliases resolved; blank is refused."""
    bare = (name or "").strip().lower()
    if not bare:
        raise ValueError("a corpus id is needed")
    return (aliases or {}).get(bare, bare)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """A chunk index: one JSON array of chunks, or Parquet. A missing path is an error."""
    if path.endswith(".json"):
        return spark.read.schema(CHUNK).json(path, multiLine=True)
    return spark.read.parquet(path)


def read_text_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, text of each .txt file in the folder itself, whatever the case of its ending."""
    raw = spark.read.text(folder, wholetext=True, pathGlobFilter="*.[tT][xX][tT]")
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_single_text(spark: SparkSession, folder: str) -> DataFrame:
    """As read_text_files for a folder that must hold exactly one."""
    found = read_text_files(spark, folder)
    n = found.select("path").limit(2).count()
    if n != 1:
        raise ValueError(f"{'no' if not n else 'more than one'} .txt file in {folder}")
    return found


def largest_source(spark: SparkSession, folder: str) -> str:
    """The largest .pdf or .txt file; none is an error."""
    found = spark.read.format("binaryFile").load(folder).select("path", "length").where(F.col("path").rlike(r"(?i)\.(pdf|txt)$"))
    row = found.orderBy(F.desc("length"), "path").first()
    if row is None:
        raise ValueError(f"no .pdf or .txt file in {folder}")
    return row.path


def read_source_text(spark: SparkSession, path: str, extract=None) -> DataFrame:
    """path, text; PDFs go through extract(bytes) -> str on the executors."""
    low = path.lower()
    if low.endswith(".txt"):
        return spark.read.text(path, wholetext=True).select(F.lit(path).alias("path"), F.col("value").alias("text"))
    if not low.endswith(".pdf") or extract is None:
        raise ValueError("only .txt, and .pdf with an extractor, can be read")

    def run(batches):
        for pdf in batches:
            yield pdf.assign(text=[extract(c) for c in pdf["content"]])[["path", "text"]]

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, text string")


INDEXES: dict[tuple[str, str], DataFrame] = {}


def load_index(spark: SparkSession, name: str, root: str, aliases: dict[str, str] | None = None, paths: dict[str, str] | None = None) -> DataFrame:
    """The chunks of a corpus: its mapped path under root, else <id>/<id>.index.json; kept for the session by canonical id.

    A missing file is an error that names the corpus and the path.
    """
    own = corpus_id(name, aliases)
    path = f"{root.rstrip('/')}/{(paths or {}).get(own, f'{own}/{own}.index.json')}"
    key = (spark.sparkContext.applicationId, path)
    if key not in INDEXES:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            raise FileNotFoundError(f"no index file for corpus '{own}' at {path}")
        INDEXES[key] = read_index(spark, path).cache()
    return INDEXES[key]


def allowed_hashes(spark: SparkSession, path: str) -> DataFrame:
    """sha256 of the lines of an allowlist; blank lines and comments (#) don't count. A missing list is created empty."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        warnings.warn(f"no allowlist at {path}: an empty one is made", stacklevel=2)
        store.setWriteChecksum(False)  # the list is edited by hand later
        store.create(place, False).close()
        store.setWriteChecksum(True)
    lines = spark.read.text(path).select(F.lower(F.trim(F.split("value", r"[\s#]")[0])).alias("sha256"))
    return lines.where("sha256 != ''").distinct()


def require_allowed(files: DataFrame, allowed: DataFrame) -> DataFrame:
    """files (path, content) if the hash of each is allowed; otherwise an error that names the first that isn't."""
    odd = check_hashes(files, allowed).where("not allowed").orderBy("path").first()
    if odd is not None:
        raise ValueError(f"RULE=PDF_HASH_UNKNOWN detail={odd.path} {odd.sha256}")
    return files


def check_hashes(files: DataFrame, allowed: DataFrame) -> DataFrame:
    """path, sha256, allowed of files (path, content) against allowed (sha256)."""
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"))
    return hashed.join(allowed.select("sha256", F.lit(True).alias("ok")).distinct(), "sha256", "left").select("path", "sha256", F.coalesce("ok", F.lit(False)).alias("allowed"))
