"""Shared helpers: work folders, packed byte views of text columns, vectorised hashes.

Rules that all operators of this subpackage keep:

* A null text counts as the empty text.
* Operators read only the columns that they are told to read, so extra columns
  (whatever their names) never clash with the ones an operator makes.
* An empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.workspace import shared_folder

_MADE: list[str] = []


def work_dir(spark: SparkSession, tag: str) -> str:
    """A new folder that driver and executors share, see shared_folder()."""
    _MADE.append(shared_folder(spark, tag))
    return _MADE[-1]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Work folders made inside are deleted at the end, but that of the last one, the result.

    For steps whose result is written before the block ends; published lexicons stay, as new executors fetch them.
    """
    mark = len(_MADE)
    yield
    for folder in _MADE[mark:-1]:
        _delete(spark, folder)
    del _MADE[mark:-1]


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = work_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_materialized(df: DataFrame) -> None:
    """Delete the files behind a frame from :func:`materialize` once nothing reads it any more."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(df.sparkSession, folder)


def fresh_names(taken: list[str], *wanted: str) -> list[str]:
    """Column names like those wanted that no column has, whatever the case."""
    lower = {c.lower() for c in taken}
    out = []
    for name in wanted:
        name = f"__{name}"
        while name.lower() in lower:
            name += "_"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    """Shuffle partitions of the session; packed exchanges make a few buckets for each."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column) -> pa.Array:
    """An Arrow string column without nulls, as one array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "") if column.null_count else column


def views(text: pa.Array, max_bytes: int = 1 << 20):
    """Yield (first row, offsets, bytes) of consecutive rows with about ``max_bytes`` bytes of text.

    ``offsets`` starts at 0. A single longer text makes a view of its own.
    """
    width = np.int64 if pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type) else np.int32
    if not len(text):
        return
    _, offs, data = text.buffers()
    offs = np.frombuffer(offs, width)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(text):
        end = int(np.searchsorted(offs, offs[row] + max_bytes, side="right")) - 1
        end = min(max(end, row + 1), len(text))
        yield row, offs[row : end + 1] - offs[row], data[offs[row] : offs[end]]
        row = end


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _joined_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A name for each pair of names; the order of the two counts."""
    with np.errstate(over="ignore"):
        h = a * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(35)
        h += b
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def joined_names(first: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """A 64-bit name for each tuple of 64-bit names."""
    for x in more:
        first = _joined_names(first, x.astype(np.uint64))
    return first


def gram_names(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit name for the ``size`` (8, 16, 32, ...) bytes from each offset on.

    Names of q-grams at offsets i and i + q make the name of the 2q-gram at i, so each step reuses
    the one before it; the first names are the eight bytes themselves.
    """
    if len(data) < size:
        return np.zeros(0, np.uint64)
    name = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,)).copy()
    name = _joined_names(name, name)
    q = 8
    while q < size:
        name = _joined_names(name[:-q], name[q:])
        q *= 2
    return name


def word_names(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit name for each word data[start:end], from all its bytes and their number."""
    n = end - start
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    name = n.astype(np.uint64)
    step, left = 0, np.arange(len(n))
    while len(left):
        block = eight[start[left] + step] & _LOW_BYTES[np.minimum(n[left] - step, 8)]
        name[left] = _joined_names(name[left], block)
        step += 8
        left = left[n[left] > step]
    return mix(name)


_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def text_key(text) -> list:
    """Two columns, k1 and k2, that name a text: 128 bits from two seeds."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


#: Bytes that part words: \x20 and \x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A-Z to a-z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words_in(data: np.ndarray, offs: np.ndarray, inside: np.ndarray):
    """Starts and ends of the maximal runs of bytes with ``inside``, never across rows, and each run's row."""
    if not len(data):
        e = np.zeros(0, np.int64)
        return e, e, e
    keep = inside[data]
    begins = keep.copy()
    begins[1:] &= ~keep[:-1]
    cuts = offs[1:-1]
    cuts = cuts[cuts < len(data)]
    begins[cuts] = keep[cuts]
    ends = keep.copy()
    ends[:-1] &= ~keep[1:]
    before = cuts[cuts > 0] - 1
    ends[before] = keep[before]
    start = np.flatnonzero(begins)
    end = np.flatnonzero(ends) + 1
    row = np.searchsorted(offs, start, side="right") - 1
    return start, end, row


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int = 5):
    """Sorted distinct hashes of the word shingles of each row, as (offsets, hashes).

    A-Z count as a-z. A row with fewer than ``size`` words has its whole sequence as its only
    shingle; a row without words has none.
    """
    data = LOWER[data]
    start, end, row = words_in(data, offs, ~SPACE)
    rows = len(offs) - 1
    word = word_names(data, start, end)
    counts = np.bincount(row, minlength=rows)
    first = np.zeros(rows + 1, np.int64)
    np.cumsum(counts, out=first[1:])
    full = np.arange(len(word)) + size <= first[row + 1]
    runs = max(0, len(word) - size + 1)
    names = joined_names(*(word[k : k + runs] for k in range(size)))
    pieces, owners = [mix(names[full[:runs]])], [row[full]]
    short = np.flatnonzero((counts > 0) & (counts < size))
    name = counts[short].astype(np.uint64)
    for k in range(size - 1):
        more = counts[short] > k
        name[more] = joined_names(name[more], word[first[short[more]] + k])
    pieces.append(mix(name))
    owners.append(short)
    hashes, owner = np.concatenate(pieces), np.concatenate(owners)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[keep], owner[keep]
    out = np.zeros(rows + 1, np.int64)
    np.cumsum(np.bincount(owner, minlength=rows), out=out[1:])
    return out, hashes


#: A key with more than this share of all rows is joined by broadcast: a thousand keys at most.
HEAVY = 1 / 1000


def spread_join(left: DataFrame, right: DataFrame, key: str, count: str, total: int | None, spread) -> DataFrame:
    """Left join with ``right``, which has one row for each ``key`` and says in ``count`` how many rows of ``left`` have it.

    Rows of the few heaviest keys find theirs by broadcast; they then join nothing, under a key made of
    ``spread`` (of the key's type), so that no task joins all rows of one key. ``total`` is the sum of ``count``.
    """
    limit = max(1000, int((total or 0) * HEAVY))
    values = [c for c in right.columns if c != key]
    own, few, most = fresh_names([*left.columns, *right.columns], "own_key", "few", "most")
    packed = right.select(F.col(key).alias(own), F.struct(*values).alias("x"), F.col(count).alias("n"))
    rows = left.join(F.broadcast(packed.where(F.col("n") > limit).select(F.col(own).alias(key), F.col("x").alias(few))), key, "left")
    rows = rows.withColumn(own, F.when(F.col(few).isNull(), F.col(key)).otherwise(spread))
    rows = rows.join(packed.where(F.col("n") <= limit).select(own, F.col("x").alias(most)), own, "left")
    value = F.coalesce(F.col(few), F.col(most))
    return rows.select(*left.columns, *[value[c].alias(c) for c in values])


#: Bytes of an Arrow batch between the JVM and a Python worker.
BATCH_BYTES = 4 << 20


def _give_back() -> None:
    """Hand freed memory back to the system, for workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def tidy(function):
    """For mapInArrow: batches bounded in bytes, and a worker that keeps no memory after the task.

    The bound is a setting of the session, read when the frame runs, so it stays set.
    """
    session = SparkSession.getActiveSession()
    if session is not None:
        session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches):
        try:
            yield from function(batches)
        finally:
            _give_back()

    return run


def deal(df: DataFrame, column: str = "pid", extra: list[str] | None = None) -> DataFrame:
    """Bring packed rows of equal ``column`` together, in order, without an aggregate.

    Numbers go to partitions in turn, so that each has as many buckets; a sender's number is its
    task's, shifted, and that of its packet.
    """
    n, key = partitions(df.sparkSession), F.col(column)
    place = F.pmod(F.shiftright(key, 24) + key.bitwiseAND(F.lit((1 << 24) - 1)), F.lit(n)).cast("int")
    return df.repartitionById(n, place).sortWithinPartitions(column, *(extra or []))


def by_key(batches, key: str):
    """Group a stream of key-ordered Arrow batches: yields (key value, table) of bounded, packed rows."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
            if held and keys[a] != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = keys[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield current, pa.Table.from_batches(held)


def unpack(table: pa.Table, column: str, dtype) -> np.ndarray:
    """The arrays in a binary column, end to end."""
    return np.frombuffer(b"".join(table.column(column).to_pylist()), dtype)
