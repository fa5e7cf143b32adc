"""Exact near-duplicate join in the Jaccard metric: pivots, Voronoi cells, triangle-inequality windows.

Documents are sets of word shingles; distance 1 - Jaccard is a metric, and a link is a distance of
at most 0.2. Nearly all pairs of documents are at distance 1 exactly, where the triangle inequality
says nothing and Voronoi regions over the whole corpus would copy every document everywhere. So
regions are seeded by shared shingles, which every pair within the distance must have, and the
metric join runs inside:

1. Sample prefixes. Each distinct set sends its smallest hashes (a fifth and a bit more). Two linked
   sets share a known number of them, so a set that has fewer shared ones is alone.
2. Rare-first prefixes. Among the sets that are left, each orders its shingles by how many sets hold
   them and keeps the rarest that it must share one of with any partner.
3. Regions. In every group that shares a kept shingle, the set whose shingles are most common, the
   most central one, is the pivot; a pivot's groups make its region. A linked pair has a region in
   common. Holders are counted, and pivots found, by combining each sender's own counts and best sets,
   so a shingle that a third of all sets hold is one small entry from each sender.
4. Cells. Members linked to the region's pivot are joined through it; only those that, by the triangle
   inequality, one of the others may reach go on with them. Then members go to the nearest of some
   pivots, and boundary members to other cells, too: a member within 0.2 of one that is nearer to p has
   a distance to p that is at most 0.4 above its smallest, and 0.2 above the cell's radius. Cells
   join recursively: over tables while they are large, in memory below ``CELL``. Cells that no pivot
   parts are compared in blocks, inside the windows of 0.2 around their distances to the pivot.
5. Links join into components.

Defined results: null is the empty text; a set without words is linked with nothing, not even its
equals; equal sets are one node and their rows one component; rows that repeat an id are rows of
their own; a null id takes part, but a component is named by its smallest id. Sets are named by 128 bits,
shingles by 64.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, deal, fresh_names, materialize, partitions, shingle_sets, spread_join, text_key, text_of, tidy, views
from .components import connected_components
from .exchange import SCHEMA, home, may_hold, membership_filter, numbered, rows, source_number, taken

#: The similarity of a link as a fraction, and how much longer than needed the sample prefix is.
LINK = (80, 100)
EXTRA = 0.06
#: Members of a block of a region.
BLOCK = 256

_HEAD = ["<i8", "<u1", "<i8", "<i8", "<i8", "<i8", "<u4", "<u4"]  # doc, has doc, text key, node, size, shingles sent
#: Kinds of packed rows: heads of rows, numbers of their shingles, shingles of a sender for their owner.
_HEADS, _ITEMS, _SENT = range(3)


def least_shared(n: np.ndarray) -> np.ndarray:
    """The fewest shingles that a set of n shares with any partner: the smallest k with 100 k >= 80 n."""
    return -(-LINK[0] * n // LINK[1])


def _node(hashes: np.ndarray) -> bytes:
    """16 bytes that name a set."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()


def _names(halves: np.ndarray) -> pa.Array:
    """Nodes, as rows of two integers, as a binary column."""
    raw = np.ascontiguousarray(halves, "<i8").tobytes()
    return pa.array([raw[i : i + 16] for i in range(0, len(raw), 16)], pa.binary())


def _sets(batches, columns: tuple[str, str]):
    """(first row, offsets, hashes, batch) for each view of each batch."""
    for batch in batches:
        for first, offs, data in views(text_of(batch.column(columns[0]))):
            cuts, hashes = shingle_sets(data, offs)
            yield first, cuts, hashes, batch


def _send_prefixes(buckets: int, whole: bool, bitmap):
    """Map side of both exchanges: each shingle of a sender (of prefixes, or all) with how many of its sets hold it.

    Which sets these are the sender tells only itself, so a shingle that a third of all sets hold is one
    small entry from each sender.
    """
    bits = bitmap.value if bitmap is not None else None

    def run(batches):
        src, seen = source_number(), set()
        if bits is not None:
            batches = (b.filter(pa.array(may_hold(bits, b.column("k1").to_numpy()))) for b in batches)
        held: list[np.ndarray] = []
        head: list[tuple[int, ...]] = []
        size = 0

        def flush():
            token, place, times = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
            order, cut = numbered((token >> np.uint64(20)).astype(np.int64) % buckets, buckets)
            number = np.empty(len(token), "<u4")
            number[order] = np.arange(len(token))
            token, times = token[order], np.minimum(times[order], 0xFFFF).astype("<u2")
            cols = list(zip(*head, strict=True))
            own = home(src, buckets)
            out = [(own, src, _HEADS, b"".join(np.array(c, k).tobytes() for c, k in zip(cols, _HEAD, strict=True)))]
            out.append((own, src, _ITEMS, number[place].tobytes()))
            # An owner finds a shingle's number by its place behind the first.
            out += [(p, src, _SENT, np.array([a], "<u4").tobytes() + token[a:b].tobytes() + times[a:b].tobytes()) for p, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if b > a]
            return rows(out)

        for first, cuts, hashes, batch in _sets(batches, ("text", "")):
            n = np.diff(cuts)
            docs = batch.column("id").slice(first, len(n))
            none = docs.is_null().to_numpy(zero_copy_only=False)
            docs = docs.fill_null(0).to_numpy()
            k1, k2 = (batch.column(c).slice(first, len(n)).to_numpy() for c in ("k1", "k2"))
            k = n - least_shared(n) + np.maximum(1, np.ceil(EXTRA * n)).astype(np.int64)
            k = n.copy() if whole else np.minimum(n, k)
            for i in range(len(n)):
                node = _node(hashes[cuts[i] : cuts[i + 1]])
                if node in seen:
                    k[i] = 0
                seen.add(node)
                head.append((int(docs[i]), 0 if none[i] else 1, int(k1[i]), int(k2[i]), *np.frombuffer(node, "<i8").tolist(), int(n[i]), int(k[i])))
            if len(seen) > 500_000:  # only repeats in between are sent twice
                seen.clear()
            take = np.arange(len(hashes)) - np.repeat(cuts[:-1], n) < np.repeat(k, n)
            held.append(hashes[take])
            size += int(take.sum())
            if size > 400_000 or len(head) > 50_000:
                yield flush()
                held.clear()
                head.clear()
                size, src = 0, src + 1
        if head:
            yield flush()

    return run


def _parts(part: pa.Table, kind: int, dtypes: list) -> list[np.ndarray] | None:
    """The arrays of all rows of a kind, end to end; None without any."""
    got = [taken(d, dtypes) for d, k in zip(part.column("data").to_pylist(), part.column("kind").to_pylist(), strict=True) if k == kind]
    return [np.concatenate(c) for c in zip(*got, strict=True)] if got else None


def _back(src: np.ndarray, kind: int, arrays: list[np.ndarray]):
    """Rows for each sender with its part of the arrays."""
    by = np.argsort(src, kind="stable")
    src, arrays = src[by], [a[by] for a in arrays]
    cuts = np.flatnonzero(np.r_[True, src[1:] != src[:-1], True]) if len(src) else [0]
    return [(int(src[a]), int(src[a]), kind, b"".join(x[a:b].tobytes() for x in arrays)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _owned(part: pa.Table, dtypes: list):
    """(rows for senders that only pass by, [*arrays, numbers, senders] of the entries or None)."""
    out, got = [], []
    for src, kind, data in zip(part.column("src").to_pylist(), part.column("kind").to_pylist(), part.column("data").to_pylist(), strict=True):
        if kind == _SENT:
            arrays = taken(data[4:], dtypes)
            first = int(np.frombuffer(data, "<u4", 1)[0])
            got.append([*arrays, np.arange(first, first + len(arrays[0]), dtype="<u4"), np.full(len(arrays[0]), src, np.int64)])
        else:
            out.append((src, src, kind, data))
    return out, [np.concatenate(c) for c in zip(*got, strict=True)] if got else None


def _count_holders(whole: bool):
    """Owners of shingles: to each sender the shingles that more than one set holds, and how many do (and the shingles)."""

    def run(batches):
        for _, part in by_key(batches, "pid"):
            out, got = _owned(part, ["<u8", "<u2"])
            if got:
                token, times, number, src = got
                order = np.argsort(token, kind="stable")
                token = token[order]
                edge = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
                total = np.repeat(np.add.reduceat(times[order].astype(np.int64), edge[:-1]), np.diff(edge))
                shared = total > 1
                order, total, token = order[shared], np.minimum(total[shared], 0xFFFFFFFF).astype("<u4"), token[shared]
                out += _back(src[order], _SENT, [number[order], total, token] if whole else [number[order], total])
            for i in range(0, len(out), 200):
                yield rows(out[i : i + 200])

    return run


def _totals(part: pa.Table, whole: bool):
    """A sender's (heads, numbers and rows of its items, holders and shingles by number)."""
    head, (number,) = _parts(part, _HEADS, _HEAD), _parts(part, _ITEMS, ["<u4"])
    at = np.repeat(np.arange(len(head[0])), head[7])
    total = np.ones(int(number.max()) + 1 if len(number) else 0, np.int64)
    token = np.zeros(len(total), np.uint64)
    answers = _parts(part, _SENT, ["<u4", "<u4", "<u8"] if whole else ["<u4", "<u4"])
    if answers:
        total[answers[0]] = answers[1]
        if whole:
            token[answers[0]] = answers[2]
    return head, number, at, total, token


def _choose(batches):
    """A sender's sets again: (doc_id, k1, k2, node, n, candidate) for each row."""
    for _, part in by_key(batches, "pid"):
        (doc, has, k1, k2, a, b, n, _), number, at, total, _ = _totals(part, False)
        shared = np.bincount(at[total[number] > 1], minlength=len(doc))
        # A partner has at least 0.8 n shingles, and its prefix an extra by its own size.
        need = np.maximum(1, np.ceil(EXTRA * LINK[0] / LINK[1] * n - 1e-9)).astype(np.int64)
        keep = (shared >= need) & (n > 0)
        columns = [pa.array(doc, pa.int64(), mask=has == 0), pa.array(k1), pa.array(k2), _names(np.stack([a, b], axis=1)), pa.array(n.astype(np.int64)), pa.array(keep)]
        yield pa.record_batch(columns, ["doc_id", "k1", "k2", "node", "n", "candidate"])


_SET = ["<i8", "<i8", "<u4", "<u4"]  # node, size, groups that it is in


def _rare_first(buckets: int):
    """A sender's sets with the counts of their shared shingles: the rarest make groups.

    To the owner of a shingle goes the group's most central set, to the sender itself all sets (heads) with
    the numbers of their groups (items).
    """

    def run(batches):
        for src, part in by_key(batches, "pid"):
            (_, _, k1, _, a, b, size, _), number, at, total, token = _totals(part, True)
            n = size.astype(np.int64)
            df = total[number]
            number, at, df = number[df > 1].astype(np.int64), at[df > 1], df[df > 1]
            order = np.lexsort((token[number], df, at))
            number, at, df = number[order], at[order], df[order]
            held = np.bincount(at, minlength=len(n))
            first = np.concatenate([[0], np.cumsum(held)])
            slots = n - least_shared(n) + 1 - (n - held)  # the single shingles come first and find nobody
            keep = np.arange(len(at)) - first[at] < slots[at]
            if not keep.any():
                continue
            central = (np.bincount(at, np.log2(df), minlength=len(n)) / np.maximum(n, 1)).astype("<f4")
            at, number = at[keep], number[keep]
            order = np.lexsort((b[at], a[at], -central[at], number))
            best = np.r_[True, number[order][1:] != number[order][:-1]]
            members = np.diff(np.flatnonzero(np.r_[best, True])).astype("<u4")
            at_best, said = at[order][best], token[number[order][best]]
            # Groups are numbered in order of their owners, as shingles were before.
            by_owner, cut = numbered((said >> np.uint64(20)).astype(np.int64) % buckets, buckets)
            group = np.zeros(len(total), "<u4")
            group[number[order][best][by_owner]] = np.arange(len(said))
            entries = [x[by_owner] for x in (said, members, a[at_best], b[at_best], central[at_best])]
            out = [(p, int(src), _SENT, np.array([x], "<u4").tobytes() + b"".join(e[x:y].tobytes() for e in entries)) for p, (x, y) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)) if y > x]
            own = home(int(src), buckets)
            used, of_set = np.unique(at, return_inverse=True)  # items are in order of their sets
            out.append((own, int(src), _HEADS, b"".join(x.tobytes() for x in (a[used], b[used], size[used].astype("<u4"), np.bincount(of_set).astype("<u4")))))
            out.append((own, int(src), _ITEMS, group[number].tobytes()))
            out.append((own, int(src), _KEYS, k1[used].tobytes()))
            yield rows(out)

    return run


#: Keys of the texts whose sets are in groups.
_KEYS = 3


def _pick_pivots(batches):
    """Owners of shingles: to each sender the most central set of all senders, the pivot of the group."""
    for _, part in by_key(batches, "pid"):
        out, got = _owned(part, ["<u8", "<u4", "<i8", "<i8", "<f4"])
        if got:
            token, members, a, b, central, number, src = got
            order = np.lexsort((b, a, -central, token))
            token = token[order]
            edge = np.flatnonzero(np.r_[True, token[1:] != token[:-1], True])
            size = np.diff(edge)
            some = np.repeat(np.add.reduceat(members[order].astype(np.int64), edge[:-1]) > 1, size)
            pivot = np.repeat(order[edge[:-1]], size)[some]
            order = order[some]
            out += _back(src[order], _SENT, [number[order], a[pivot], b[pivot]])
        for i in range(0, len(out), 200):
            yield rows(out[i : i + 200])


def _regions(batches):
    """A sender's groups: (pivot, node, n) for each member, once for each sender."""
    for _, part in by_key(batches, "pid"):
        sets, items, pivots = _parts(part, _HEADS, _SET), _parts(part, _ITEMS, ["<u4"]), _parts(part, _SENT, ["<u4", "<i8", "<i8"])
        if not sets or not pivots:
            continue
        a, b, size, groups = sets
        of_set = np.repeat(np.arange(len(a)), groups)
        place = np.full(int(max(items[0].max(), pivots[0].max())) + 1, -1, np.int64)
        place[pivots[0]] = np.arange(len(pivots[0]))
        at = place[items[0]]
        of_set, at = of_set[at >= 0], at[at >= 0]
        # Equal sets sent by several tasks are one node.
        rows_of = np.stack([pivots[1][at], pivots[2][at], a[of_set], b[of_set], size[of_set].astype(np.int64)], axis=1)
        rows_of = rows_of[(rows_of[:, 0] != rows_of[:, 2]) | (rows_of[:, 1] != rows_of[:, 3])]
        if len(rows_of):
            rows_of = rows_of[np.lexsort(rows_of.T[::-1])]
            rows_of = rows_of[np.r_[True, (rows_of[1:] != rows_of[:-1]).any(axis=1)]]
            yield pa.record_batch([_names(rows_of[:, :2]), _names(rows_of[:, 2:4]), pa.array(rows_of[:, 4])], ["pivot", "node", "n"])


def _whole_sets(bitmap):
    """(node, set) of the texts that the filter lets through, once for each task."""
    bits = bitmap.value

    def run(batches):
        seen: set[bytes] = set()
        batches = (b.filter(pa.array(may_hold(bits, b.column("k1").to_numpy()))) for b in batches)
        for _, cuts, hashes, _ in _sets(batches, ("text", "")):
            out = []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                node = _node(hashes[a:b])
                if b > a and node not in seen:
                    seen.add(node)
                    out.append((node, hashes[a:b].tobytes()))
            if len(seen) > 500_000:
                seen.clear()
            if out:
                yield pa.record_batch([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["node", "shingles"])

    return run


def _linked(shared, n, m):
    return LINK[1] * shared >= LINK[0] * (n + m - shared)


def _dense_overlaps(left: list[np.ndarray], right: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Intersection sizes of all pairs of two bounded blocks, by products of 0/1 matrices."""
    x, y = np.concatenate(left), np.concatenate(right)
    common = np.intersect1d(np.unique(x), np.unique(y), assume_unique=True)
    out = np.zeros((len(left), len(right)), np.float32)

    def spots(sets, values):
        at = np.searchsorted(common, values)
        at[at == len(common)] = 0
        ok = common[at] == values
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[ok], at[ok]

    if len(common):
        (lr, lc), (rr, rc) = spots(left, x), spots(right, y)
        for a in range(0, len(common), columns):
            width = min(columns, len(common) - a)
            m, n = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
            i, j = (lc >= a) & (lc < a + width), (rc >= a) & (rc < a + width)
            m[lr[i], lc[i] - a] = 1
            n[rr[j], rc[j] - a] = 1
            out += m @ n.T
    return np.rint(out).astype(np.int64)


#: The triangle window: a link's distance, with room for rounding.
REACH = 1 - LINK[0] / LINK[1] + 1e-9


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Pairs whose sizes allow a link."""
    return (LINK[1] * n >= LINK[0] * m) & (LINK[1] * m >= LINK[0] * n)


def _far_apart(sets: list[np.ndarray], sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to k pivots, each far from those before: (their places, distances to them, whether linked to them)."""
    chosen, columns, links = [0], [], []
    while True:
        at = chosen[-1]
        shared = _dense_overlaps(sets, [sets[at]])[:, 0]
        columns.append(1 - shared / (sizes + sizes[at] - shared))
        links.append(_linked(shared, sizes, sizes[at]))
        nearest = np.min(columns, axis=0)
        if len(chosen) == k or nearest.max() <= REACH:
            return np.array(chosen), np.stack(columns, axis=1), np.stack(links, axis=1)
        chosen.append(int(np.argmax(nearest)))


def cell_links(sets: list[np.ndarray], own: np.ndarray, joined: np.ndarray, leaf: int = 64, pivots: int = 8) -> list[tuple[int, int]]:
    """Links that connect all linked sets of which one at least is ``own`` and one at least isn't ``joined``; in memory.

    The first set is the first pivot: members linked to it are joined through it, and only those that one of
    the others may reach go on with them. Then sets go to the nearest of a few pivots, boundary sets
    by the triangle inequality to other cells, too, and cells join recursively. A cell that doesn't get
    smaller is compared along its pivot's distances, window by window.
    """
    sizes = np.array([len(s) for s in sets])
    out: list[tuple[int, int]] = []

    def compare(left: np.ndarray, right: np.ndarray, mine: np.ndarray, yours: np.ndarray) -> None:
        """All pairs of two bounded blocks with an own member and one that isn't joined."""
        wanted = (mine[:, None] | yours[None, :]) & ~(joined[left][:, None] & joined[right][None, :]) & _fits(sizes[left][:, None], sizes[right][None, :])
        if wanted.any():
            shared = _dense_overlaps([sets[i] for i in left], [sets[i] for i in right])
            hit = wanted & _linked(shared, sizes[left][:, None], sizes[right][None, :])
            out.extend((int(left[i]), int(right[j])) for i, j in zip(*np.nonzero(hit), strict=True) if left[i] != right[j])

    index = np.arange(len(sets))
    if len(index) > leaf:
        shared = _dense_overlaps(sets, sets[:1])[:, 0]
        d, linked = 1 - shared / (sizes + sizes[0] - shared), _linked(shared, sizes, sizes[0])
        linked[0] = False
        out += [(0, i) for i in np.flatnonzero(linked & (own | own[0])).tolist()]
        joined = joined | linked
        outer = ~linked & (index > 0)
        index = index[outer | linked & (d >= d[outer].min() - REACH)] if outer.any() else index[:0]
    todo = [(index, own[index])]
    while todo:
        index, mine = todo.pop()
        if not mine.any() or len(index) < 2 or joined[index].all():
            continue
        if len(index) <= leaf:
            compare(index, index, mine, mine)
            continue
        centres, d, linked = _far_apart([sets[i] for i in index], sizes[index], pivots)
        near = d.argmin(axis=1)
        for p, c in enumerate(centres):
            hit = linked[:, p] & (mine | mine[c])
            hit[c] = False
            out.extend((int(index[c]), int(i)) for i in index[hit])
            home = near == p
            if not (home & mine).any():
                continue
            core = linked[:, p]
            inside = (d[:, p] <= d.min(axis=1) + 2 * REACH) & (d[:, p] <= d[home, p].max() + REACH)
            outer = inside & ~core
            if not outer.any():
                continue
            # Core members are joined through the pivot; only those that an outer one may reach go on.
            inside &= ~core | (d[:, p] >= d[outer, p].min() - REACH)
            inside[c] = False
            cell = np.flatnonzero(inside)
            if len(cell) < 0.7 * len(index):
                todo.append((index[cell], (mine & home)[cell]))
                continue
            cell = cell[np.argsort(d[cell, p], kind="stable")]
            owned, away, fresh = (mine & home)[cell], d[cell, p], ~joined[index[cell]]
            for some, others in ((owned & fresh, np.ones(len(cell), bool)), (owned & ~fresh, fresh)):
                some, others = np.flatnonzero(some), np.flatnonzero(others)
                for a in range(0, len(some), 256):
                    f = some[a : a + 256]
                    low, high = np.searchsorted(away[others], [away[f[0]] - REACH, away[f[-1]] + REACH], side="left")
                    for b in range(int(low), int(high) + 1, 256):
                        g = others[b : min(b + 256, int(high) + 1)]
                        compare(index[cell[f]], index[cell[g]], owned[f], owned[g])
    return out


def _join_cells(batches):
    """Whole cells in memory: links."""
    for _, part in by_key(batches, "block"):
        cells: dict[bytes, list] = {}
        for cell, node, own, joined, data in zip(*(part.column(c).to_pylist() for c in ("cell", "node", "own", "joined", "shingles")), strict=True):
            cells.setdefault(cell, []).append((node != cell, node, own, joined, data))  # a region's pivot comes first
        out: set[tuple[bytes, bytes]] = set()
        for members in cells.values():
            members.sort()
            names = [m[1] for m in members]
            found = cell_links([np.frombuffer(m[4], "<u8") for m in members], np.array([m[2] for m in members]), np.array([m[3] for m in members]))
            out |= {(min(names[i], names[j]), max(names[i], names[j])) for i, j in found}
        if out:
            a, b = zip(*sorted(out), strict=True)
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def _to_pivots(batches):
    """Blocks of a cell with its pivots: (cell, pivot, node, n, own, joined, home, d, linked) where a member may belong to a pivot's cell."""
    for _, part in by_key(batches, "block"):
        cells: dict[bytes, tuple[list, list]] = {}
        for row in part.select(["cell", "node", "own", "joined", "centre", "shingles"]).to_pylist():
            cells.setdefault(row["cell"], ([], []))[row["centre"]].append(row)
        for cell, (members, centres) in cells.items():
            if not members or not centres:
                continue
            centres = list({c["node"]: c for c in sorted(centres, key=lambda c: c["node"])}.values())
            left, right = ([np.frombuffer(r["shingles"], "<u8") for r in side] for side in (members, centres))
            n, m = (np.array([len(s) for s in side]) for side in (left, right))
            shared = _dense_overlaps(left, right)
            d = 1 - shared / (n[:, None] + m[None, :] - shared)
            linked = _linked(shared, n[:, None], m[None, :])
            home = np.zeros(d.shape, bool)
            home[np.arange(len(n)), d.argmin(axis=1)] = True
            i, j = np.nonzero(d <= d.min(axis=1)[:, None] + 2 * REACH)
            columns = [
                pa.array([hashlib.blake2b(cell + centres[y]["node"], digest_size=16).digest() for y in j.tolist()], pa.binary()),
                pa.array([centres[y]["node"] for y in j.tolist()], pa.binary()),
                pa.array([members[x]["node"] for x in i.tolist()], pa.binary()),
                pa.array(n[i].astype(np.int64)),
                pa.array([members[x]["own"] for x in i.tolist()], pa.bool_()),
                pa.array([members[x]["joined"] for x in i.tolist()], pa.bool_()),
                pa.array(home[i, j]),
                pa.array(d[i, j]),
                pa.array(linked[i, j]),
            ]
            yield pa.record_batch(columns, ["cell", "pivot", "node", "n", "own", "joined", "home", "d", "linked"])


def _compare_blocks(batches):
    """Blocks of a cell that doesn't get smaller, inside the triangle window: links."""
    for _, part in by_key(batches, "task"):
        groups: dict[tuple, list] = {}
        for row in part.select(["cell", "pair", "side", "node", "own", "joined", "d", "shingles"]).to_pylist():
            groups.setdefault((row["cell"], row["pair"]), []).append(row)
        out: set[tuple[bytes, bytes]] = set()
        for members in groups.values():
            left = [r for r in members if r["side"] != 1]
            right = [r for r in members if r["side"] != 0]
            if not left or not right:
                continue
            ls, rs = ([np.frombuffer(r["shingles"], "<u8") for r in side] for side in (left, right))
            ld, rd = (np.array([r["d"] for r in side]) for side in (left, right))
            lo, ro = (np.array([r["own"] for r in side]) for side in (left, right))
            lj, rj = (np.array([r["joined"] for r in side]) for side in (left, right))
            ln, rn = (np.array([len(s) for s in side]) for side in (ls, rs))
            near = np.abs(ld[:, None] - rd[None, :]) <= REACH  # triangle inequality
            near &= _fits(ln[:, None], rn[None, :]) & (lo[:, None] | ro[None, :]) & ~(lj[:, None] & rj[None, :])
            if not near.any():
                continue
            hit = near & _linked(_dense_overlaps(ls, rs), ln[:, None], rn[None, :])
            for i, j in zip(*np.nonzero(hit), strict=True):
                a, b = left[i]["node"], right[j]["node"]
                if a != b:
                    out.add((min(a, b), max(a, b)))
        if out:
            a, b = zip(*sorted(out), strict=True)
            yield pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def shingle_nodes(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, texts): rows (doc_id, k1, k2, node, n, candidate) of all documents after step 1; texts (id, k1, k2, text)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), *text_key(text), text.alias("text"))
    buckets = 2 * partitions(docs.sparkSession)
    sent = texts.mapInArrow(tidy(_send_prefixes(buckets, False, None)), SCHEMA)
    counted = deal(sent).mapInArrow(tidy(_count_holders(False)), SCHEMA)
    chosen = deal(counted).mapInArrow(tidy(_choose), "doc_id long, k1 long, k2 long, node binary, n long, candidate boolean")
    return materialize(chosen, "jaccard-rows"), texts


def _regions_of(texts: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps 2 and 3: (cell, node, n) of regions, whose cell is their pivot; (node, shingles) of their sets."""
    context, buckets = texts.sparkSession.sparkContext, 2 * partitions(texts.sparkSession)
    some = context.broadcast(membership_filter(nodes.where("candidate"), "k1"))  # 2 MB
    sent = texts.mapInArrow(tidy(_send_prefixes(buckets, True, some)), SCHEMA)
    counted = deal(sent).mapInArrow(tidy(_count_holders(True)), SCHEMA)
    grouped = materialize(deal(counted).mapInArrow(tidy(_rare_first(buckets)), SCHEMA), "jaccard-groups")

    def keys(batches):
        for batch in batches:
            yield pa.record_batch([pa.array(np.frombuffer(b"".join(batch.column("data").to_pylist()), "<i8"))], ["k1"])

    fewer = context.broadcast(membership_filter(grouped.where(F.col("kind") == _KEYS).mapInArrow(tidy(keys), "k1 long"), "k1"))
    picked = deal(grouped.where(F.col("kind") != _KEYS)).mapInArrow(tidy(_pick_pivots), SCHEMA)
    pairs = deal(picked).mapInArrow(tidy(_regions), "pivot binary, node binary, n long").distinct()
    member = materialize(pairs.select(F.col("pivot").alias("cell"), "node", "n"), "jaccard-regions")
    whole = materialize(texts.mapInArrow(tidy(_whole_sets(fewer)), "node binary, shingles binary").dropDuplicates(["node"]), "jaccard-sets")
    return member, whole


#: What a member of a cell weighs beside its shingles; 64 MB of shingles or 8,192 members are joined in one place.
_WEIGHT = 512
CELL = 8192 * _WEIGHT * 2
PIVOTS = 16


def _sized(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell").agg(F.sum(F.col("n") + _WEIGHT).alias("weight"), F.count("*").alias("members"))


def _with_sizes(cells: DataFrame, sizes: DataFrame, wanted, columns: list[str]) -> DataFrame:
    """Members of the cells whose sizes are ``wanted``, with ``columns`` of the sizes."""
    total = sizes.agg(F.sum("members")).head()[0]
    some = sizes.select("cell", *columns, "members", wanted.alias("wanted"))
    return spread_join(cells, some, "cell", "members", total, F.col("node")).where("wanted").drop("members", "wanted")


def _split(cells: DataFrame, sizes: DataFrame, whole: DataFrame, cell_weight: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """One Voronoi round over large cells: (links to pivots, members of the new cells).

    Without ``pivots``, regions (whose cell is their pivot's name) lose what is joined through the pivot.
    """
    large = materialize(_with_sizes(cells, sizes, F.col("weight") > cell_weight, ["weight"]), "jaccard-large")
    # Members with the smallest hash under each of some seeds are pivots: one small aggregate, whatever the size.
    seeds = [F.min_by("node", F.xxhash64(F.lit(i), "node")).alias(f"p{i}") for i in range(pivots)]
    centres = large.groupBy("cell").agg(F.max("weight").alias("weight"), *seeds)
    chosen = F.array_distinct(F.array(*[f"p{i}" for i in range(pivots)])) if pivots else F.array("cell")
    blocks = F.ceil(F.col("weight") * 8 / cell_weight)
    each = centres.select("cell", chosen.alias("ps"), F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("part"))
    each = each.select("cell", F.explode("ps").alias("node"), F.lit(False).alias("own"), F.lit(False).alias("joined"), F.lit(1).alias("centre"), "part")
    mine = large.select("cell", "node", "own", "joined", F.lit(0).alias("centre"), F.pmod(F.xxhash64("node", "cell"), blocks).alias("part"))
    filled = mine.unionByName(each).join(whole, "node").select("cell", "node", "own", "joined", "centre", "shingles", F.xxhash64("cell", "part").alias("block"))
    schema = "cell binary, pivot binary, node binary, n long, own boolean, joined boolean, home boolean, d double, linked boolean"
    near = materialize(deal(filled, "block").mapInArrow(tidy(_to_pivots), schema), "jaccard-distances")
    links = near.where("linked and node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    edge = near.groupBy("cell").agg(
        F.max(F.when(F.col("home"), F.col("d"))).alias("radius"),
        F.count(F.when(F.col("home") & F.col("own"), 1)).alias("owners"),
        F.count(F.when(~F.col("joined"), 1)).alias("fresh"),
        F.min(F.when(~F.col("linked"), F.col("d"))).alias("outer"),
        F.count("*").alias("members"),
    )
    total = edge.agg(F.sum("members")).head()[0]
    known = spread_join(near, edge, "cell", "members", total, F.col("node"))
    inside = (F.col("owners") > 0) & (F.col("fresh") > 0) & F.col("outer").isNotNull() & (F.col("d") <= F.col("radius") + REACH)
    reached = ~F.col("linked") | (F.col("d") >= F.col("outer") - REACH)
    kept = known.where(inside & reached & (F.col("node") != F.col("pivot")))
    joined = F.col("joined") if pivots else F.col("linked")
    return links, kept.select("cell", "node", "n", (F.col("own") & F.col("home")).alias("own"), joined.alias("joined"), "d", "linked")


def _block_links(cells: DataFrame, whole: DataFrame) -> DataFrame:
    """Links in cells that don't get smaller: outer members in blocks against each other and against the core's."""
    edge = cells.groupBy("cell").agg(F.count(F.when(~F.col("linked"), 1)).alias("outer"), F.count("*").alias("members"))
    total = edge.agg(F.sum("members")).head()[0]
    around = spread_join(cells, edge, "cell", "members", total, F.col("node"))
    n_out = F.ceil(F.col("outer") / BLOCK)
    n_core = F.ceil((F.col("members") - F.col("outer")) / BLOCK)
    mine = F.pmod(F.xxhash64("node", "cell"), F.when(F.col("linked"), F.greatest(n_core, F.lit(1))).otherwise(n_out))
    around = around.select("cell", "node", "own", "joined", "d", "linked", n_out.alias("n_out"), n_core.alias("n_core"), mine.alias("mine"))
    count = lambda n: F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)) - 1)
    # Sides: 0 left, 1 right, 2 both (a block of outer sets with itself).
    place = lambda side, pair: F.struct(F.lit(side).alias("side"), pair.alias("pair"))
    with_outer = F.transform(
        count(F.col("n_out")),
        lambda j: F.struct(
            F.when(j == F.col("mine"), 2).when(F.col("mine") < j, 0).otherwise(1).alias("side"),
            F.concat(F.lit("o"), F.least(j, F.col("mine")), F.lit("-"), F.greatest(j, F.col("mine"))).alias("pair"),
        ),
    )
    with_core = F.when(F.col("n_core") > 0, F.transform(count(F.col("n_core")), lambda k: place(0, F.concat(F.lit("c"), F.col("mine"), F.lit("-"), k)))).otherwise(F.array().cast("array<struct<side:int,pair:string>>"))
    from_core = F.transform(count(F.col("n_out")), lambda i: place(1, F.concat(F.lit("c"), i, F.lit("-"), F.col("mine"))))
    spread = around.select("cell", "node", "own", "joined", "d", F.explode(F.when(F.col("linked"), from_core).otherwise(F.concat(with_outer, with_core))).alias("x"))
    spread = spread.select("cell", "node", "own", "joined", "d", "x.side", "x.pair").join(whole, "node")
    tasks = spread.select("cell", "node", "own", "joined", "d", "side", "pair", "shingles", F.xxhash64("cell", "pair").alias("task"))
    return deal(tasks, "task").mapInArrow(tidy(_compare_blocks), "a binary, b binary")


def near_links(texts: DataFrame, nodes: DataFrame, cell_weight: int = CELL) -> DataFrame:
    """Steps 2 to 4: (a, b) links between different sets that connect all that are linked."""
    member, whole = _regions_of(texts, nodes)
    # The pivot is a member of its region like any other.
    pivots = member.groupBy("cell").agg(F.max("n").alias("n")).select("cell", F.col("cell").alias("node"), "n")
    cells = member.unionByName(pivots).withColumn("own", F.lit(True)).withColumn("joined", F.lit(False))
    found: DataFrame | None = None
    for pivots in itertools.chain([0], itertools.repeat(PIVOTS)):
        sizes = materialize(_sized(cells), "jaccard-sizes")
        heaviest = sizes.agg(F.max("weight")).head()[0] or 0
        small = cells if heaviest <= cell_weight else _with_sizes(cells, sizes, F.col("weight") <= cell_weight, [])
        small = small.select("cell", "node", "own", "joined").join(whole, "node")
        links = deal(small.withColumn("block", F.xxhash64("cell")), "block").mapInArrow(tidy(_join_cells), "a binary, b binary")
        found = links if found is None else found.unionByName(links)
        if heaviest <= cell_weight:
            return found
        to_pivots, inner = _split(cells, sizes, whole, cell_weight, pivots)
        found = found.unionByName(to_pivots)
        cells = materialize(inner, "jaccard-cells")
        if pivots and (_sized(cells).agg(F.max("weight")).head()[0] or 0) > 0.7 * heaviest:
            # No pivot parts the heaviest cells: compare these inside the windows, block by block.
            sizes = materialize(_sized(cells), "jaccard-sizes")
            stuck = F.col("weight") > F.greatest(F.lit(cell_weight), F.lit(0.7 * heaviest))
            found = found.unionByName(_block_links(materialize(_with_sizes(cells, sizes, stuck, []), "jaccard-stuck"), whole))
            cells = materialize(_with_sizes(cells, sizes, ~stuck, []), "jaccard-cells")
        cells = cells.select("cell", "node", "n", "own", "joined")
    raise AssertionError("rounds end with the return above")


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id."""
    return _components(docs, text_col, id_col).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def _components(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """(doc_id, k1, k2, node, n, component) for each row; sets without words have no component."""
    nodes, texts = shingle_nodes(docs, text_col, id_col)
    roots = connected_components(near_links(texts, nodes))
    low = nodes.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("times"))
    named = materialize(low.join(roots, "node", "left").select("node", "low", "times", F.coalesce("root", "node").alias("root")), "jaccard-named")
    lowest = named.groupBy("root").agg(F.min("low").alias("component"), F.count("*").alias("members"))
    total = named.agg(F.count("*"), F.sum("times")).head()
    of_node = spread_join(named, lowest, "root", "members", total[0], F.col("node")).select("node", "root", "component", "times")
    # All empty sets are one node, which is in no component.
    rows = nodes.withColumn("node", F.when(F.col("n") > 0, F.col("node")).otherwise(F.concat(F.col("node"), F.coalesce(F.col("doc_id").cast("string").cast("binary"), F.lit(b"")))))
    salt = F.concat(F.col("node"), F.coalesce(F.col("doc_id").cast("string").cast("binary"), F.lit(b"")))
    return spread_join(rows, of_node, "node", "times", total[1], salt)


def keep_one_of_each(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of each component, with all its columns: of the rows with its smallest id one of the text with the smallest key.

    Rows without words stay; a row with a null id stays only if its component has no other id, and of
    such rows one.
    """
    rows = materialize(_components(docs, text_col, id_col), "jaccard-components")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    # By the component's node, not its id: ids may repeat, or be null.
    rows = rows.withColumn("group", F.hex("root"))
    best = rows.where("n > 0").groupBy("group").agg(F.min(key).alias("best"), F.count("*").alias("rows"))
    total = best.agg(F.sum("rows")).head()[0]
    judged = spread_join(rows, best, "group", "rows", total, F.concat(F.lit("s"), F.hex("node"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    stays = F.col("best.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("best.k1") == F.col("k1")) & (F.col("best.k2") == F.col("k2"))
    gone_id, g1, g2 = fresh_names(docs.columns, "gone_id", "k1", "k2")
    gone = judged.where((F.col("n") > 0) & ~stays).select(F.col("doc_id").alias(gone_id), F.col("k1").alias(g1), F.col("k2").alias(g2)).distinct()
    one, two = text_key(F.coalesce(F.col(text_col), F.lit("")))
    at_id = F.col(id_col).cast("long")
    kept = docs.join(gone, at_id.eqNullSafe(F.col(gone_id)) & (one == F.col(g1)) & (two == F.col(g2)), "left_anti")
    again = rows.where("n > 0").groupBy("doc_id", "k1", "k2").count().where("count > 1").select(F.col("doc_id").alias(gone_id), F.col("k1").alias(g1), F.col("k2").alias(g2))
    again = materialize(again, "jaccard-again")
    if again.isEmpty():
        return kept
    # Rows that repeat id and text: an aggregate leaves one of each.
    on = at_id.eqNullSafe(F.col(gone_id)) & (one == F.col(g1)) & (two == F.col(g2))
    once = kept.join(again, on, "left_semi").withColumn(gone_id, at_id).withColumn(g1, one).withColumn(g2, two).dropDuplicates([gone_id, g1, g2]).select(*docs.columns)
    return kept.join(again, on, "left_anti").unionByName(once)
