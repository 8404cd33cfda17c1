"""What several operators need: the shared scratch folder, ASCII folding, stable splits."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import TypeVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")
#: The letters that the contracts fold, and their lower-case forms.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


_HELD: dict = {}


def held(key: tuple, make: Callable[[], T]) -> T:
    """What make() gives for this key, kept by the Python worker until it is asked for something else.

    A worker serves one operator after another; the caches of those before would stay in its memory.
    """
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def release() -> None:
    """Let go of what the Python worker holds; for operators that hold nothing."""
    _HELD.clear()


class Recent(dict):
    """What make(key) gives, kept for two generations of at most `kept` keys: one not asked for during a generation goes with the next."""

    def __init__(self, kept: int, make: Callable | None = None):
        super().__init__()
        self.kept, self.make = kept, make
        self.before: dict = {}

    def put(self, key, value) -> None:
        if len(self) >= self.kept:
            self.before = dict(self)
            self.clear()
        self[key] = value

    def __missing__(self, key):
        found = self.before.get(key)
        if found is None:
            found = self.make(key)
        self.put(key, found)
        return found


_FOLDER: ContextVar[str] = ContextVar("folder", default="tables")


def scratch_root(spark: SparkSession) -> str:
    """The folder of this application below spark.checkpoint.dir, which all executors share.

    Only where that setting is absent on a single machine (tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="kinseg-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/kinseg-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back.

    This cuts the lineage: what follows survives the loss of executors without
    running df again, and df runs once however often the result is used.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{_FOLDER.get()}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing reads any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def clean(spark: SparkSession, folder: str = "") -> None:
    """Delete every scratch table of this application, or those of one folder; call it once results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch_root(spark)}/{folder}".rstrip("/"))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def folder(name: str) -> Iterator[None]:
    """Within, written() puts its tables into a folder of their own, which clean() can delete alone."""
    token = _FOLDER.set(name)
    try:
        yield
    finally:
        _FOLDER.reset(token)


def whole(text: Column | str) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def folded(text: Column) -> Column:
    """Lower-case A-Z and nothing else; pure ASCII takes the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def remainder(doc_id: Column | str, modulus: int) -> Column:
    """crc32 of doc_id written as text, modulo modulus; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return (F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % modulus).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
