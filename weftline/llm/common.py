"""Plumbing shared by the corpus operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whatever is broadcast is checked against this bound first.
BROADCAST_BYTES = 64 << 20

_PER_PROCESS: dict = {}


def per_process(key, build: Callable, alone: bool = False):
    """Build a value once in each Python worker; the last few keys stay. A large value can ask to be alone: others whose key starts alike go first."""
    if key not in _PER_PROCESS:
        for k in [k for k in _PER_PROCESS if alone and k[0] == key[0]]:
            _PER_PROCESS.pop(k)
        while len(_PER_PROCESS) >= 8:
            _PER_PROCESS.pop(next(iter(_PER_PROCESS)))
        _PER_PROCESS[key] = build()
    return _PER_PROCESS[key]


def broadcast_bytes(spark: SparkSession, blob: bytes, what: str):
    """Broadcast a blob whose size is checked against BROADCAST_BYTES."""
    if len(blob) > BROADCAST_BYTES:
        raise ValueError(f"{what} has {len(blob)} bytes; at most {BROADCAST_BYTES} are broadcast")
    return spark.sparkContext.broadcast(blob)


def slices(batch: pa.RecordBatch, text_at: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `most` bytes of text; a longer text is alone. What a worker holds at once is so bounded."""
    size = pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_pylist()
    low = total = 0
    for i, n in enumerate(size):
        if total and total + n > most:
            yield batch.slice(low, i - low)
            low, total = i, 0
        total += n
    if low < batch.num_rows:
        yield batch.slice(low)


def workers(spark: SparkSession) -> None:
    """In local mode let Python workers find this package wherever the driver was started; a cluster gets it by --py-files."""
    sc = spark.sparkContext
    if sc.master.startswith("local"):
        root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
        known = sc.environment.get("PYTHONPATH", "")
        if root not in known.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [known, root]))


def map_texts(
    docs: DataFrame,
    func: Callable[[list[str | None]], dict[str, list]],
    schema: pa.Schema,
    ddl: str,
    *,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """Apply `func` to the texts of each Arrow batch; `keep` columns pass through untouched.

    Only the named columns are read, so further columns of any name do no harm.
    """
    workers(docs.sparkSession)
    src = docs.select(*[docs[c] for c in keep], docs[text_col].alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(keep)])
    names = list(schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole, len(keep))):
            out = func(b.column(len(keep)).to_pylist())
            cols = [b.column(i) for i in range(len(keep))] + [pa.array(out[n], schema.field(n).type) for n in names]
            yield pa.RecordBatch.from_arrays(cols, [*keep, *names])

    return src.mapInArrow(run, f"{kept}, {ddl}" if kept else ddl)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of our own only where none is set, as in local tests."""
    sc = spark.sparkContext
    workers(spark)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = os.path.join(tempfile.gettempdir(), "weftline-checkpoints")
    sc.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """Materialise and cut lineage in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: A key with more rows is hot: there are at most as many hot keys as the table has rows, divided by this.
HOT_ROWS = 1_000_000


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], count: str, hot: int = HOT_ROWS) -> DataFrame:
    """Inner join with `small`, which has one row a key and the key's rows in `big` as `count`. Rows of hot keys meet a broadcast side and are not shuffled."""
    small = cut(small)
    lots = small.where(F.col(count) > hot)
    plain = small.where(F.col(count) <= hot).drop(count)
    n = lots.count()
    if not n or n > 100_000:
        return big.join(small.drop(count), keys)
    lots = F.broadcast(lots.drop(count))
    return big.join(lots, keys).unionByName(big.join(lots, keys, "left_anti").join(plain, keys))


def shuffle_width(df: DataFrame) -> int:
    """Partitions of the next shuffle, as the session is set."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def no_rows(spark: SparkSession, ddl: str) -> DataFrame:
    return spark.createDataFrame([], ddl)


def col_or_null(df: DataFrame, name: str, kind: str):
    return df[name] if name in df.columns else F.lit(None).cast(kind)


def held_out(id_col):
    """Rows whose crc32(id as text) mod 5 is 0; null ids are not."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))
