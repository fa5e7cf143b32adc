"""Repeated-substring removal by bucket-pointer refinement of sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. Suffixes are
sorted only as far as ``length`` bytes, and only where a repeat can be. A bucket is named by 64 bits:

1. Names of q-grams. The eight bytes from each offset on are its first bucket. The names at offsets
   i and i + q make the name of the bucket of 2q bytes at i, for q = 8, 16, 32, 64: each round sorts by
   names of later offsets and uses those that the round before made.
2. Initial buckets. Every window of ``length`` bytes is filed under the suffix in it whose 128-gram
   has the smallest name. Equal windows choose the same suffix at the same place, so about one
   suffix in 36 stands for all. Suffixes of equal 128-gram share a bucket; a bucket of one is done.
3. First refinement. Buckets are sorted by the names at the offsets where the first and the last window
   of a suffix begin and end, which cover all of them. Suffixes that agree are repeats with all
   their windows, and one speaks for all.
4. Second refinement. Where a bucket still has different suffixes, each of their windows is named by the
   two buckets at its offsets 0 and ``length`` - 128, and windows of equal names are repeats.

A bucket that is hot, a line that a third of all texts share, is never in one place: a sender whose own
suffixes differ within a bucket sends them by the name of the next round and says only once that the
bucket is mixed; windows are sent by their own names; and what a sender holds twice leaves it once.
So an owner meets as many rows of one name as there are senders, whatever the number of texts.

Texts whose every byte is the same in two rows are found by counting and lose everything at once,
so a group of copies with a third of the rows is one text here. All matches are of two 64-bit names that
cover all bytes, and texts are named by 128 bits.

Defined results: null is the empty text; texts under ``length`` bytes lose nothing; rows that
repeat an id are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, deal, fresh_names, gram_names, joined_names, materialize, partitions, text_key, text_of, tidy, views
from .exchange import SCHEMA, dealt, home, may_hold, membership_filter, rows, source_number, taken

#: Bytes of a q-gram; windows hold length - GRAM + 1 of them.
GRAM = 128
_PIECE = 4 << 20
_MULTI = 128


def _pieces(offs: np.ndarray, data: np.ndarray, length: int):
    """(rows, starts in the piece, base of the first) with at most a few MB of text.

    A long text comes in pieces that overlap by length - 1 bytes, so that each window is in one.
    """
    if len(data) <= _PIECE:
        yield np.arange(len(offs) - 1), offs, data, 0
        return
    for row in range(len(offs) - 1):
        text = data[offs[row] : offs[row + 1]]
        for base in range(0, max(1, len(text) - length + 1), _PIECE):
            part = text[base : base + _PIECE + length - 1]
            yield np.array([row]), np.array([0, len(part)]), part, base


def _window_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i : i + width]) for each i, by doubling."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def sampled_runs(offs: np.ndarray, data: np.ndarray, length: int):
    """Runs of windows that one suffix stands for: (first window, windows - 1, name of its gram, name of the run)."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    gram = gram_names(data, GRAM)
    packed = (gram >> np.uint64(24) << np.uint64(24)) | np.arange(len(gram), dtype=np.uint64)
    chosen = (_window_minimum(packed, length - GRAM + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
    valid = np.zeros(len(data) + 1, np.int32)
    long_enough = np.diff(offs) >= length
    np.add.at(valid, offs[:-1][long_enough], 1)
    np.add.at(valid, offs[1:][long_enough] - length + 1, -1)
    valid = np.cumsum(valid)[: len(chosen)] > 0
    change = np.ones(len(chosen) + 1, bool)
    change[1:-1] = (chosen[1:] != chosen[:-1]) | ~(valid[1:] & valid[:-1])
    # Two texts of exactly `length` bytes in a row still differ by their chosen suffix.
    edge = np.flatnonzero(change)
    keep = valid[edge[:-1]]
    first, last = edge[:-1][keep], edge[1:][keep] - 1
    # With the suffix's own gram, those where its windows begin and end cover all their bytes.
    own = chosen[first]
    name = joined_names(gram[first], gram[last + length - GRAM], own - first, last - first)
    return first, last - first, gram[own], name


#: Kinds of packed rows. Senders' own tables, repeats and suffixes to refine go back to them.
_TABLE, _BY_GRAM, _SETTLED, _REPEAT, _AGAIN, _BY_NAME = range(6)
_SUFFIX = ["<u8", "<u8", "<u4", "<u1"]  # gram, run, first window, windows - 1
#: In place of a first window: the sender has different suffixes in this bucket and sends them by their names.
_MIXED = np.uint32(0xFFFFFFFF)


def _send_suffixes(length: int, buckets: int):
    """Texts' (start, base, k1, k2); suffixes to the owners of their gram or run; repeats found on the spot."""

    def run(batches):
        src, seen = source_number(), set()
        table: list[np.ndarray] = []
        found: list[tuple[np.ndarray, ...]] = []
        size, place = 0, 0

        def flush():
            first, more, gram, name = (np.concatenate(c) for c in zip(*found, strict=True))
            order = np.lexsort((name, gram))
            first, more, gram, name = first[order], more[order], gram[order], name[order]
            bucket = np.r_[True, gram[1:] != gram[:-1]][: len(gram)]
            new = bucket.copy()
            new[1:] |= name[1:] != name[:-1]
            group = np.cumsum(new) - 1
            many = (np.bincount(group, minlength=1) > 1)[group] if len(group) else new
            out = [(home(src, buckets), src, _TABLE, b"".join(np.concatenate(c).astype("<i8").tobytes() for c in zip(*table, strict=True)))]
            if many.any():
                out.append((home(src, buckets), src, _SETTLED, first[many].astype("<u4").tobytes() + more[many].astype("<u4").tobytes()))
            of_bucket = np.cumsum(bucket) - 1
            mixed = (np.bincount(of_bucket, new.astype(np.int64), 1) > 1)[of_bucket] if len(of_bucket) else new
            size = (more | np.where(many, _MULTI, 0)).astype("<u1")
            for kind, chosen, key in ((_BY_GRAM, new & ~mixed, gram), (_BY_NAME, new & mixed, name)):
                pid = (key[chosen] >> np.uint64(32)).astype(np.int64) % buckets
                arrays = [gram[chosen], name[chosen], first[chosen].astype("<u4"), size[chosen]]
                out += [(p, src, kind, d) for p, d in dealt(pid, buckets, arrays)]
            said = gram[bucket & mixed]
            arrays = [said, said, np.full(len(said), _MIXED, "<u4"), np.zeros(len(said), "<u1")]
            out += [(p, src, _BY_GRAM, d) for p, d in dealt((said >> np.uint64(32)).astype(np.int64) % buckets, buckets, arrays)]
            return rows(out)

        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            fresh = np.zeros(len(k1), bool)
            for i, k in enumerate(zip(k1.tolist(), k2.tolist(), strict=True)):
                if k not in seen:
                    seen.add(k)
                    fresh[i] = True
            if len(seen) > 500_000:  # only copies in between are sent twice, which is no mistake
                seen.clear()
            batch = batch.filter(pa.array(fresh))
            k1, k2 = k1[fresh], k2[fresh]
            for at, offs, data in views(text_of(batch.column("text"))):
                for row, starts, part, base in _pieces(offs, data, length):
                    first, more, gram, name = sampled_runs(starts, part, length)
                    table.append((starts[:-1] + place, np.full(len(row), base), k1[at + row], k2[at + row]))
                    found.append((first + place, more, gram, name))
                    place += len(part)
                    size += len(first)
                    if size > 250_000 or place > 1 << 30:
                        yield flush()
                        table.clear()
                        found.clear()
                        size, place, src = 0, 0, src + 1
        if table:
            yield flush()

    return run


def _by_sender(src: np.ndarray, *arrays: np.ndarray):
    """(sender, bytes of its part of each array) for each sender."""
    by = np.argsort(src, kind="stable")
    src, arrays = src[by], [a[by] for a in arrays]
    cuts = np.flatnonzero(np.r_[True, src[1:] != src[:-1], True]) if len(src) else [0]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(src[a]), b"".join(x[a:b].tobytes() for x in arrays)


def _refine(batches):
    """Owners: repeats, and suffixes to refine again, back to their senders."""
    for _, part in by_key(batches, "pid"):
        out: list[tuple[int, int, int, bytes]] = []
        got: dict[int, list[list[np.ndarray]]] = {_BY_GRAM: [], _BY_NAME: []}
        for src, kind, data in zip(part.column("src").to_pylist(), part.column("kind").to_pylist(), part.column("data").to_pylist(), strict=True):
            if kind in got:
                arrays = taken(data, _SUFFIX)
                got[kind].append([*arrays, np.full(len(arrays[0]), src, np.int64)])
            else:
                out.append((src, src, kind, data))
        for kind, lists in got.items():
            if not lists:
                continue
            gram, name, first, more, src = (np.concatenate(c) for c in zip(*lists, strict=True))
            lists.clear()
            order = np.lexsort((name, gram))
            gram, name, first, more, src = gram[order], name[order], first[order], more[order], src[order]
            bucket = np.r_[True, gram[1:] != gram[:-1]]
            same = bucket | np.r_[True, name[1:] != name[:-1]]
            of_bucket, of_name = np.cumsum(bucket) - 1, np.cumsum(same) - 1
            real = first != _MIXED
            repeated = (np.bincount(of_name)[of_name] > 1) & real
            mixed = np.ones(len(gram), bool) if kind == _BY_NAME else (np.bincount(of_bucket, same.astype(np.int64)) > 1)[of_bucket]
            again = mixed & same & real  # one of each run; those that agree are settled, but one speaks for the others
            length = (more & (_MULTI - 1)).astype("<u4")
            for answer, chosen in ((_REPEAT, repeated), (_AGAIN, again)):
                out += [(s, s, answer, d) for s, d in _by_sender(src[chosen], first[chosen], length[chosen])]
        for i in range(0, len(out), 200):
            yield rows(out[i : i + 200])


def _marks(batches):
    """A sender's answers by text: (k1, k2, repeats, again), arrays of (first window, windows - 1)."""
    for _, part in by_key(batches, "pid"):
        table, answers = None, {True: [], False: []}
        for kind, data in zip(part.column("kind").to_pylist(), part.column("data").to_pylist(), strict=True):
            if kind == _TABLE:
                table = taken(data, ["<i8", "<i8", "<i8", "<i8"])
            else:
                answers[kind == _AGAIN].append(taken(data, ["<u4", "<u4"]))
        start, base, k1, k2 = table
        marks: dict[tuple[int, int], list[list[bytes]]] = {}
        for again, lists in answers.items():
            if not lists:
                continue
            first, more = (np.concatenate(c).astype(np.int64) for c in zip(*lists, strict=True))
            order = np.argsort(first, kind="stable")
            first, more = first[order], more[order]
            row = np.searchsorted(start, first, side="right") - 1
            cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                r = row[a]
                pairs = np.stack([first[a:b] - start[r] + base[r], more[a:b]], axis=1).astype("<i8")
                marks.setdefault((int(k1[r]), int(k2[r])), [[], []])[again].append(pairs.tobytes())
        if marks:
            keys, found = list(marks), list(marks.values())
            yield pa.record_batch(
                [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([b"".join(v[0]) for v in found], pa.binary()), pa.array([b"".join(v[1]) for v in found], pa.binary())],
                ["k1", "k2", "repeats", "again"],
            )


def _chosen_texts(bitmap):
    """(k1, k2, text) of the texts that the filter lets through, once for each task."""
    bits = bitmap.value

    def run(batches):
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            hit = may_hold(bits, batch.column("k1").to_numpy())
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True))
            for i in np.flatnonzero(hit).tolist():
                if keys[i] in seen:
                    hit[i] = False
                seen.add(keys[i])
            if len(seen) > 500_000:
                seen.clear()
            yield batch.filter(pa.array(hit))

    return run


def _pairs(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs or ()), "<i8").reshape(-1, 2)


def _windows(pairs: np.ndarray) -> np.ndarray:
    """All windows of (first, windows - 1) pairs, each once."""
    n = pairs[:, 1] + 1
    return np.unique(np.repeat(pairs[:, 0] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())) if len(pairs) else np.zeros(0, np.int64)


_WINDOW = ["<u8", "<u8", "<u4"]  # buckets at both offsets, place


def _send_windows(length: int, buckets: int):
    """The windows to refine, by the buckets at their two offsets; texts' (place, base, k1, k2), and repeats on the spot."""

    def run(batches):
        src = source_number()
        table: list[tuple[int, int, int, int]] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        place = size = 0

        def flush():
            one, two, spot = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((two, one))
            one, two, spot = one[order], two[order], spot[order]
            new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])][: len(one)]
            group = np.cumsum(new) - 1
            many = (np.bincount(group, minlength=1) > 1)[group] if len(group) else new
            out = [(home(src, buckets), src, _TABLE, b"".join(np.array(c, "<i8").tobytes() for c in zip(*table, strict=True)))]
            if many.any():
                out.append((home(src, buckets), src, _SETTLED, spot[many].astype("<u4").tobytes()))
            one, two, spot = one[new], two[new], spot[new].astype("<u4")
            pid = ((one ^ two) >> np.uint64(20)).astype(np.int64) % buckets
            out += [(p, src, _BY_NAME, d) for p, d in dealt(pid, buckets, [one, two, spot])]
            return rows(out)

        for batch in batches:
            marks = [_windows(_pairs(x)) for x in batch.column("again").to_pylist()]
            keys = list(zip(batch.column("k1").to_pylist(), batch.column("k2").to_pylist(), strict=True))
            for at, offs, data in views(text_of(batch.column("text"))):
                for row, starts, part, base in _pieces(offs, data, length):
                    gram = gram_names(part, GRAM)
                    for r, s, e in zip(row.tolist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                        w = marks[at + r]
                        w = w[(w >= base) & (w < base + min(_PIECE, max(0, e - s - length + 1)))] - base
                        if len(w):
                            held.append((gram[s + w], gram[s + w + length - GRAM], place + w))
                            table.append((place, base, *keys[at + r]))
                            place += int(w[-1]) + 1
                            size += len(w)
                    if size > 400_000 or place > 1 << 30:
                        yield flush()
                        table.clear()
                        held.clear()
                        place, size, src = 0, 0, src + 1
        if held:
            yield flush()

    return run


def _match_windows(batches):
    """Owners of names: the places of windows that occur twice, back to their senders."""
    for _, part in by_key(batches, "pid"):
        out, got = [], []
        for src, kind, data in zip(part.column("src").to_pylist(), part.column("kind").to_pylist(), part.column("data").to_pylist(), strict=True):
            if kind == _BY_NAME:
                arrays = taken(data, _WINDOW)
                got.append([*arrays, np.full(len(arrays[0]), src, np.int64)])
            else:
                out.append((src, src, kind, data))
        if got:
            one, two, spot, src = (np.concatenate(c) for c in zip(*got, strict=True))
            del got
            order = np.lexsort((two, one))
            one, two = one[order], two[order]
            edge = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]), True]
            hit = order[~(edge[:-1] & edge[1:])]
            out += [(s, s, _SETTLED, d) for s, d in _by_sender(src[hit], spot[hit])]
        for i in range(0, len(out), 200):
            yield rows(out[i : i + 200])


def _window_marks(batches):
    """A sender's matched windows by text: (k1, k2, windows)."""
    for _, part in by_key(batches, "pid"):
        table, spots = None, []
        for kind, data in zip(part.column("kind").to_pylist(), part.column("data").to_pylist(), strict=True):
            if kind == _TABLE:
                table = taken(data, ["<i8", "<i8", "<i8", "<i8"])
            else:
                spots.append(np.frombuffer(data, "<u4"))
        if not spots:
            continue
        # Places rise from piece to piece; less its base they would not, so the base counts only in the subtraction.
        place, base, k1, k2 = table
        spot = np.unique(np.concatenate(spots)).astype(np.int64)
        row = np.searchsorted(place, spot, side="right") - 1
        cuts = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
        own = row[cuts[:-1]]
        windows = [(spot[a:b] - place[r] + base[r]).astype("<i8").tobytes() for a, b, r in zip(cuts[:-1], cuts[1:], own, strict=True)]
        yield pa.record_batch([pa.array(k1[own]), pa.array(k2[own]), pa.array(windows, pa.binary())], ["k1", "k2", "windows"])


def _covered(n: int, length: int, pairs: np.ndarray, windows: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, pairs[:, 0] + pairs[:, 1] + length, -1)
    np.add.at(edge, windows, 1)
    np.add.at(edge, windows + length, -1)
    return np.cumsum(edge[:-1]) > 0


def _cut(length: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, repeats, windows in zip(*(batch.column(c).to_pylist() for c in ("text", "repeats", "windows")), strict=True):
                raw = np.frombuffer(text.encode(), np.uint8)
                gone = _covered(len(raw), length, _pairs(repeats), np.frombuffer(b"".join(windows or ()), "<i8"))
                spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
                kept = raw[~gone].tobytes()
                out.append((int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept if spans else None))
            cols = list(zip(*out, strict=True)) if out else [()] * 4
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)]
            yield pa.record_batch([batch.column("k1"), batch.column("k2"), *made], ["k1", "k2", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _keyed(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*text_key(text), text.alias("text"))


KEY = ["k1", "k2"]


def cut_texts(docs: DataFrame, length: int = 200, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(cuts, copies): cuts (k1, k2, n_removed, n_spans, kept_sha256, kept) of texts that lose bytes by windows;
    copies (k1, k2, n) of texts that more than one row has. The key is that of text_key().
    """
    if length < GRAM + 2 or length - GRAM > _MULTI - 2:
        raise ValueError(f"length must be between {GRAM + 2} and {GRAM + _MULTI - 2}")
    spark = docs.sparkSession
    buckets = 2 * partitions(spark)
    texts = _keyed(docs, text_col)
    copies = materialize(texts.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1"), "suffix-copies")
    sent = texts.mapInArrow(tidy(_send_suffixes(length, buckets)), SCHEMA)
    refined = deal(sent).mapInArrow(tidy(_refine), SCHEMA)
    marks = deal(refined).mapInArrow(tidy(_marks), "k1 long, k2 long, repeats binary, again binary")
    # A text that several tasks hold has a row from each; equal answers are one.
    marks = materialize(marks.groupBy(*KEY).agg(F.collect_set("repeats").alias("repeats"), F.collect_set("again").alias("again")), "suffix-marks")
    bitmap = spark.sparkContext.broadcast(membership_filter(marks, "k1"))  # 2 MB
    some = texts.mapInArrow(tidy(_chosen_texts(bitmap)), "k1 long, k2 long, text string").dropDuplicates(KEY)
    marked = materialize(some.join(marks, KEY), "suffix-texts")
    windows = marked.select(*KEY, "text", "again").mapInArrow(tidy(_send_windows(length, buckets)), SCHEMA)
    matched = deal(windows).mapInArrow(tidy(_match_windows), SCHEMA)
    more = deal(matched).mapInArrow(tidy(_window_marks), "k1 long, k2 long, windows binary").groupBy(*KEY).agg(F.collect_list("windows").alias("windows"))
    both = marked.select(*KEY, "text", "repeats").join(more, KEY, "left")
    cuts = both.mapInArrow(tidy(_cut(length)), "k1 long, k2 long, n_removed long, n_spans long, kept_sha256 string, kept binary").where("n_spans > 0")
    return cuts, copies


#: Copies of a text with more than this share of all copies are looked up by broadcast: a thousand texts at most.
_HEAVY = 1 / 1000


def _with_losses(docs: DataFrame, lost: DataFrame, copies: DataFrame, names: list[str], spread) -> DataFrame:
    """``docs``, which has the key in ``names[:2]``, with lost's columns and whether the text is copied (``names[2]``).

    Rows of the few heaviest texts find it by broadcast and then join nothing, by a key of their own made
    from ``spread``, so that no task joins all rows of one text.
    """
    a, b, copied, hot = names
    limit = max(1000, int((copies.agg(F.sum("n")).head()[0] or 0) * _HEAVY))
    few = F.broadcast(copies.where(F.col("n") > limit).select(F.col("k1").alias(a), F.col("k2").alias(b), F.lit(True).alias(hot)))
    rows = docs.join(few, [a, b], "left")
    rows = rows.withColumn(a, F.when(F.col(hot), F.xxhash64(spread)).otherwise(F.col(a)))
    light = lost.withColumnsRenamed({"k1": a, "k2": b}).join(copies.where(F.col("n") <= limit).select(F.col("k1").alias(a), F.col("k2").alias(b), F.lit(True).alias(copied)), [a, b], "full_outer")
    return rows.join(light, [a, b], "left").withColumn(copied, F.coalesce(F.col(hot), F.col(copied), F.lit(False)))


def repeated_bytes(docs: DataFrame, length: int = 200, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    cuts, copies = cut_texts(docs, length, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), *text_key(text), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    lost = cuts.select(*KEY, "n_removed", "n_spans", "kept_sha256")
    out = _with_losses(base, lost, copies, [*KEY, "copied", "hot"], F.col("doc_id"))
    whole = F.col("copied") & (F.col("n_bytes") >= length)
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def cut_repeats(docs: DataFrame, length: int = 200, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with each text cut to its remaining bytes; bytes that are no whole character any more go too.

    A null text stays null, and so do all other columns as they are. No row is dropped.
    """
    cuts, copies = cut_texts(docs, length, text_col)
    a, b, copied, hot, rest, new = fresh_names(docs.columns, "key", "key2", "copied", "hot", "rest", "new")

    def text_from(batches):
        for batch in batches:
            texts = pa.array([x.decode("utf-8", "ignore") for x in batch.column("kept").to_pylist()], pa.string())
            yield pa.record_batch([batch.column("k1"), batch.column("k2"), texts], ["k1", "k2", rest])

    lost = cuts.select(*KEY, "kept").mapInArrow(tidy(text_from), f"k1 long, k2 long, `{rest}` string")
    text = F.coalesce(F.col(text_col), F.lit(""))
    one, two = text_key(text)
    keyed = docs.withColumn(a, one).withColumn(b, two)
    out = _with_losses(keyed, lost, copies, [a, b, copied, hot], F.col(id_col))
    whole = F.col(copied) & (F.octet_length(text) >= length)
    cut = F.when(F.col(text_col).isNotNull(), F.when(whole, F.lit("")).otherwise(F.coalesce(F.col(rest), text)))
    return out.withColumn(new, cut).select(*[F.col(new).alias(c) if c == text_col else F.col(c) for c in docs.columns])
