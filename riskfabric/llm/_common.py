"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import re
import tempfile
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskfabric.session import shared_path

#: The white space of every contract here: the class ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"
WHITE_BYTES = WHITE.encode()

#: Rows of one Arrow batch are worked on in slices of about this many bytes of text.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 8 << 20


def text_of(text_col: str) -> Column:
    """The text column; null counts as the empty text."""
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only ``doc_id`` and ``text`` go on, so other columns can't clash with ours."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def packed(docs: DataFrame) -> DataFrame:
    """All columns as one struct ``doc``, so that names of ours beside it can't clash with them."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back: the lineage
    is cut, the plan runs once, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Hand freed memory back to the system: a worker lives on, and its memory counts as the executor's."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


_HELD: dict = {}


def enter(owner: str) -> None:
    """Operators follow each other in the same workers: what another one has kept goes."""
    if _HELD.get("owner") != owner:
        _HELD.clear()
        _HELD["owner"] = owner
        give_back()


def held(owner: str, key, make):
    """What an operator keeps in a worker from task to task, made once."""
    enter(owner)
    if key not in _HELD:
        _HELD[key] = make()
    return _HELD[key]


def worker_mb(spark: SparkSession) -> int:
    """MB that a task may let an engine of its own hold: an eighth of its share of the
    executor's heap, which is a part of what the executor has beside it."""
    conf = spark.sparkContext.getConf()
    local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
    size = conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g").lower()
    mb = int(size[:-1]) * {"k": 1 / 1024, "m": 1, "g": 1024, "t": 1 << 20}[size[-1]] if size[-1] in "kmgt" else int(size) / (1 << 20)
    slots = spark.sparkContext.defaultParallelism if local else int(conf.get("spark.executor.cores", "1"))
    return max(64, min(400, int(mb / (8 * max(1, slots)))))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of about ``size`` bytes of ``column`` (a
    longer single text is a slice of its own), so that what a task holds
    doesn't follow the batch size."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i in range(n):
            if i > start and total + sizes[i] > size:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += sizes[i]
        yield batch.slice(start, n - start)
    give_back()


class TwoGenerations(dict):
    """A bounded cache.  ``begin()``, called before each slice of work, makes the
    entries the old generation once there are ``limit`` of them, and the old
    generation goes; what is asked for again moves over."""

    def __init__(self, limit: int):
        super().__init__()
        self.limit, self.old = limit, {}

    def begin(self) -> None:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()

    def missing(self, keys) -> list:
        """The keys in neither generation; those of the old one are taken over."""
        out, old = [], self.old
        for k in keys:
            if k not in self:
                if k in old:
                    self[k] = old[k]
                else:
                    out.append(k)
        return out


_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def chunks(text: bytes, size: int = SLICE_BYTES) -> Iterator[bytes]:
    """A text in pieces of about ``size`` bytes that end before white space."""
    start = 0
    while len(text) - start > size and (m := _BREAK.search(text, start + size)):
        yield text[start:m.start()]
        start = m.start()
    yield text[start:]


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that the
    functions of Python stages import there wherever the driver was started,
    and bound the Arrow batches of the session."""
    sc = spark.sparkContext
    if getattr(sc, "_package_shipped", None) != sc.applicationId:
        root = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="pyfiles-")) / f"{root.name}.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(archive))
        # texts are long: what a batch holds, in the JVM and in a worker, doesn't follow its number of rows
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        sc._package_shipped = sc.applicationId
