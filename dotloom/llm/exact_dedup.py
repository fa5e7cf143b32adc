"""Exact duplicate detection with an extendible-hash index on shared files.

1. Map side: each task normalises its texts, hashes them and keeps one entry for each distinct
   text it meets (byte comparison inside the task), so a text that makes up a third of the table
   leaves every task once.
2. Directory: distinct keys are counted by their leading bits. Starting from one bucket, overfull
   buckets are split; when a bucket is as deep as the directory, the directory doubles. It has
   ``2 ** max_depth`` cells at most, whatever the size of the table; a bucket that is overfull there
   goes on splitting by the bits that follow, which are written beside its cell.
3. Owner tasks: each owns the key ranges of some buckets, reads the entries in key order, chains
   entries of equal key, and tells collisions apart by comparing bytes. The finished buckets are
   index files in the shared folder.
4. Every row looks its key up in the index. The few groups with more than a thousandth of all rows,
   at most a thousand, are broadcast, so that no task joins all rows of one of them.

Defined results: null text is the empty text. Exactly one row of a group stays: the one with the
smallest id, where a null id comes after all others; of rows that repeat that id the one whose text
as written has the smallest digest; of rows that repeat that too, any one. Rows that repeat an id with
another text belong to the other text's group. All rows count in ``group_size``. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_names, materialize, partitions, text_of, tidy

_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


def normalise(text: str) -> bytes:
    """UTF-8 of the text with every run of \\x20 and \\x09-\\x0D replaced by one space."""
    return _SPACES.sub(b" ", text.encode())


def _fast_normalise(raw: bytes) -> bytes:
    words = raw.split()
    if not words:
        return b" " if raw else b""
    lead = b" " if raw[0] in b" \t\n\v\f\r" else b""
    return lead + b" ".join(words) + (b" " if raw[-1] in b" \t\n\v\f\r" else b"")


def key_of(norm: bytes) -> int:
    """The 64-bit index key, signed."""
    return int.from_bytes(hashlib.blake2b(norm, digest_size=8).digest(), "big", signed=True)


def _keys(batches):
    for batch in batches:
        norms = [_fast_normalise(t) for t in text_of(batch.column("text")).cast(pa.binary()).to_pylist()]
        keys, shas = [key_of(n) for n in norms], [hashlib.sha256(n).digest() for n in norms]
        yield pa.record_batch([batch.column("id"), batch.column("raw"), batch.column("pos"), pa.array(keys, pa.int64()), pa.array(shas, pa.binary())], ["id", "raw", "pos", "key", "sha"])


def _rank(row: tuple) -> tuple:
    """Order of (id, raw, ...): null ids last."""
    return (row[0] is None, row[0] or 0, row[1])


def _merged(a: tuple, b: tuple) -> tuple:
    """Of two (lowest id, its digest, rows with both, rows), the one of all their rows."""
    low, high = (a, b) if _rank(a) <= _rank(b) else (b, a)
    return low[0], low[1], low[2] + (high[2] if _rank(low) == _rank(high) else 0), low[3] + high[3]


_LOW = "low_id long, low_raw binary, n_low long, n long"


def _entries(limit: int):
    def run(batches):
        held: dict[bytes, tuple] = {}
        size = 0

        def flush():
            rows = list(held.items())
            for i in range(0, len(rows), 500):
                part = rows[i : i + 500]
                low = list(zip(*(v for _, v in part), strict=True))
                yield pa.record_batch(
                    [pa.array([key_of(n) for n, _ in part], pa.int64()), pa.array([n for n, _ in part], pa.binary())] + [pa.array(c, t) for c, t in zip(low, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)],
                    ["key", "norm", "low_id", "low_raw", "n_low", "n"],
                )

        for batch in batches:
            for doc, raw, text in zip(batch.column("id").to_pylist(), batch.column("raw").to_pylist(), text_of(batch.column("text")).cast(pa.binary()).to_pylist(), strict=True):
                norm = _fast_normalise(text)
                row = (doc, raw, 1, 1)
                got = held.get(norm)
                held[norm] = row if got is None else _merged(got, row)
                size += len(norm) + 200 if got is None else 0
                if size > limit:
                    yield from flush()
                    held.clear()
                    size = 0
        yield from flush()

    return run


def build_directory(counts: dict[int, int], capacity: int, max_depth: int) -> tuple[int, list[tuple[int, int]]]:
    """Extendible hashing over counted prefixes: (global depth, (bucket prefix, local depth) by directory cell).

    ``counts`` maps the first ``max_depth`` bits of keys to the number of distinct keys there.
    """
    depth = 0
    directory = [(0, 0)]
    loads = {(0, 0): sum(counts.values())}
    members = {(0, 0): counts}
    todo = [(0, 0)]
    while todo:
        bucket = todo.pop()
        prefix, local = bucket
        if loads[bucket] <= capacity or local == max_depth:
            continue
        if local == depth:  # the directory doubles: each cell is copied to two
            directory = [cell for cell in directory for _ in (0, 1)]
            depth += 1
        for bit in (0, 1):
            half = (prefix * 2 + bit, local + 1)
            members[half] = {p: c for p, c in members[bucket].items() if p >> (max_depth - local - 1) & 1 == bit}
            loads[half] = sum(members[half].values())
            span = 1 << (depth - local - 1)
            directory[half[0] * span : (half[0] + 1) * span] = [half] * span
            todo.append(half)
        del members[bucket], loads[bucket]
    return depth, directory


def deeper_bits(counts: dict[int, int], capacity: int, depth: int, directory: list[tuple[int, int]], max_depth: int) -> list[int]:
    """For each cell, by how many further bits its bucket splits: none above the deepest level."""
    out = []
    for prefix, local in directory:
        load = counts.get(prefix, 0) if local == max_depth else 0
        out.append(max(0, -(-load // capacity) - 1).bit_length())
    return out


def _chain(batches):
    """Rows come in key order: chain the distinct texts of a key, comparing bytes."""
    current, chain = None, []

    def done():
        # Ordered by bytes, so a position in the chain never depends on arrival.
        rows = sorted(chain)
        low = list(zip(*(r[1] for r in rows), strict=True))
        return pa.record_batch(
            [
                pa.array([current] * len(rows), pa.int64()),
                pa.array(range(len(rows)), pa.int32()),
                pa.array([hashlib.sha256(r[0]).digest() for r in rows], pa.binary()),
                *(pa.array(c, t) for c, t in zip(low, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)),
            ],
            ["key", "link", "sha", "keep_id", "keep_raw", "n_keep", "group_size"],
        )

    out = []
    for batch in batches:
        for key, norm, *low in zip(*(batch.column(c).to_pylist() for c in ("key", "norm", "low_id", "low_raw", "n_low", "n")), strict=True):
            if key != current:
                if chain:
                    out.append(done())
                current, chain = key, []
            for link in chain:
                if link[0] == norm:
                    link[1] = _merged(link[1], tuple(low))
                    break
            else:
                chain.append([norm, tuple(low)])
        if out:
            yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]
            out = []
    if chain:
        yield done()


def _digest(text: Column) -> Column:
    """16 bytes for a text as it is written."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def build_index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", bucket_capacity: int = 1000, max_depth: int = 14, combine_bytes: int = 24 << 20) -> tuple[DataFrame, DataFrame]:
    """(keys of all rows, index): the index has key, link (place in the chain), sha, keep_id, keep_raw, n_keep, group_size."""
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _digest(text).alias("raw"), text.alias("text"))
    # Row numbers are used only as they were written.
    keys = materialize(rows.withColumn("pos", F.monotonically_increasing_id()).mapInArrow(tidy(_keys), "id long, raw binary, pos long, key long, sha binary"), "exact-keys")
    prefix = F.shiftrightunsigned("key", 64 - max_depth)
    counted = keys.groupBy("key").agg(F.lit(1).alias("one")).groupBy(prefix.alias("p")).count()
    # At most 2 ** max_depth rows come to the driver.
    counts = {r.p: r["count"] for r in counted.collect()}
    depth, directory = build_directory(counts, bucket_capacity, max_depth)
    numbers: dict[tuple[int, int], int] = {}
    more = deeper_bits(counts, bucket_capacity, depth, directory, max_depth)
    cells = [(i, numbers.setdefault(b, len(numbers)), n) for i, (b, n) in enumerate(zip(directory, more, strict=True))]
    entries = rows.mapInArrow(tidy(_entries(combine_bytes)), f"key long, norm binary, {_LOW}")
    if depth:
        lookup = F.broadcast(spark.createDataFrame(cells, "cell int, bucket int, deeper int"))  # 2 ** max_depth rows at most
        entries = entries.withColumn("cell", F.shiftrightunsigned("key", 64 - depth).cast("int")).join(lookup, "cell").drop("cell")
        entries = entries.withColumn("part", F.when(F.col("deeper") > 0, F.expr(f"shiftrightunsigned(shiftleft(key, {max_depth}), 64 - deeper)")).otherwise(F.lit(0)))
    else:
        entries = entries.withColumn("bucket", F.lit(0)).withColumn("part", F.lit(0))
    owned = entries.repartition(partitions(spark), "bucket", "part").sortWithinPartitions("key")
    chained = owned.select("key", "norm", "low_id", "low_raw", "n_low", "n").mapInArrow(tidy(_chain), "key long, link int, sha binary, keep_id long, keep_raw binary, n_keep long, group_size long")
    return keys, materialize(chained, "exact-index")


#: Groups with more than this share of all rows are looked up by broadcast: a thousand at most.
_HEAVY = 1 / 1000


def _judged(keys: DataFrame, index: DataFrame) -> DataFrame:
    """keys with keep_id, group_size, and kept for exactly one row of each group."""
    total = index.agg(F.sum("group_size").alias("n"), F.max("n_keep").alias("most")).head()
    limit = F.lit(max(1000, int((total.n or 0) * _HEAVY)))
    found, on = index.select("key", "sha", "keep_id", "keep_raw", "n_keep", "group_size"), ["key", "sha"]
    heavy = F.broadcast(found.where(F.col("group_size") > limit))
    rows = keys.join(heavy, on).unionByName(keys.join(heavy.select(*on), on, "left_anti").join(found.where(F.col("group_size") <= limit), on))
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("raw") == F.col("keep_raw"))
    if (total.most or 0) < 2:
        return rows.withColumn("kept", same)
    # Rows that repeat the id and the text that stay: one of them, found by an aggregate.
    first = rows.where(same & (F.col("n_keep") > 1)).groupBy(*on).agg(F.min("pos").alias("first"))
    return rows.join(first, on, "left").withColumn("kept", same & ((F.col("n_keep") == 1) | (F.col("pos") == F.col("first"))))


def exact_groups(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **index_options) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = _judged(*build_index(docs, text_col, id_col, **index_options))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **index_options) -> DataFrame:
    """One row of each group, the one that stays, with all its columns."""
    keys, index = build_index(docs, text_col, id_col, **index_options)
    judged = _judged(keys, index)
    gone, tied, raw = fresh_names(docs.columns, "gone_id", "tied_id", "raw")
    at_id, at_raw = F.col(id_col).cast("long"), _digest(F.col(text_col))
    same = F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("raw") == F.col("keep_raw"))
    dropped = judged.where(~same).select(F.col("id").alias(gone), F.col("raw").alias(raw)).distinct()
    kept = docs.join(dropped, at_id.eqNullSafe(F.col(gone)) & (at_raw == F.col(raw)), "left_anti")
    again = index.where("n_keep > 1").select(F.col("keep_id").alias(tied), F.col("keep_raw").alias(raw))
    if again.isEmpty():
        return kept
    # Rows that repeat id and text: an aggregate leaves one of each, and every task sends one at most.
    on = at_id.eqNullSafe(F.col(tied)) & (at_raw == F.col(raw))
    once = kept.join(again, on, "left_semi").withColumn(raw, at_raw).withColumn(tied, at_id).dropDuplicates([tied, raw]).select(*docs.columns)
    return kept.join(again, on, "left_anti").unionByName(once)
