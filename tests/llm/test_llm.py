"""The operators on small and odd tables against brute force."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from dotloom.llm import (
    common,
    components,
    exact_dedup,
    jaccard,
    licenses,
    packing,
    queries,
    sql,
    suffix_dedup,
    tokens,
    topk,
    toxicity,
    url_filter,
    words,
)

SF = "/root/testdata/sf0.001"
#: Columns that clash with names that the operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, key long, tkey string, node long, id string, keep_id string, score string, label int, __key string"
NEAR = " ".join(f"w{i}" for i in range(60))


def odd_rows():
    rng = random.Random(7)
    long_text = " ".join(rng.choice(["alpha", "beta", "gamma", "Ünï", "x1", "it's"]) + str(rng.randrange(3000)) for _ in range(20_000))
    texts = [None, "", " ", "\t\n", "one", "a b c", "A  B\nC", "a b c", long_text, long_text, NEAR, NEAR.replace("w30 ", "other "), NEAR.upper(), NEAR + " " + NEAR, "é" * 300, "é" * 300 + "!", "日本語 テスト <|endoftext|> x", None, ""]
    rows = [(i, t, None if i % 3 else "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [(5, "a b c", "en", "s", 5), (None, "a b c", None, None, None), (None, "alone here", None, None, None)]
    return [r + (1, "k", 2, "i", "z", "y", 0, "q") for r in rows]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def pairs(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def rows(df):
    return sorted(map(repr, map(tuple, df.collect())))


def same(got, truth):
    assert rows(got) == sorted(map(repr, truth))


# -- exact dedup


def brute_exact(docs):
    """One row of each group is kept: smallest id (null last), then smallest digest of the text as written, then any."""
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in docs]
    groups = defaultdict(list)
    for i, ((d, t), n) in enumerate(zip(docs, norm, strict=True)):
        groups[n].append((d is None, d or 0, hashlib.md5((t or "").encode()).digest(), i))
    for i, ((d, _), n) in enumerate(zip(docs, norm, strict=True)):
        low = min(groups[n])
        yield d, None if low[0] else low[1], len(groups[n]), low[3] == i, hashlib.sha256(n.encode()).hexdigest()


def test_exact(odd, empty, documents):
    for df in (odd, documents):
        for options in ({}, {"bucket_capacity": 2, "combine_bytes": 100}):
            same(exact_dedup.exact_groups(df, **options), brute_exact(pairs(df)))
    assert exact_dedup.exact_groups(empty).isEmpty() and exact_dedup.drop_exact_copies(empty).isEmpty()
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    norms = lambda docs: sorted(repr((d, re.sub(r"\s+", " ", t or ""))) for d, t in docs)
    assert norms(pairs(kept)) == norms([x for x, r in zip(pairs(odd), brute_exact(pairs(odd)), strict=True) if r[3]])


def test_repeated_ids_lose_no_text(spark):
    rows_ = [(1, "x"), (2, "x"), (2, "y"), (2, "y"), (3, "y  z"), (3, "y z"), (None, "x"), (None, "u"), (None, "u"), (4, None), (4, "")]
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    got = [(d, " ".join((t or "").split())) for d, t in pairs(exact_dedup.drop_exact_copies(df))]
    assert sorted(map(repr, got)) == sorted(map(repr, [(1, "x"), (2, "y"), (3, "y z"), (None, "u"), (4, "")]))
    same(exact_dedup.exact_groups(df), brute_exact(pairs(df)))
    near = NEAR.replace("w30 ", "other ")
    rows_ = [(1, NEAR), (2, near), (2, "other text"), (3, near), (3, near), (None, NEAR), (None, "alone"), (None, "alone"), (5, ""), (5, "")]
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    assert sorted(map(repr, pairs(jaccard.keep_one_of_each(df)))) == sorted(map(repr, [(1, NEAR), (2, "other text"), (None, "alone"), (5, ""), (5, "")]))


def test_deeper_buckets():
    counts = {0: 5000, 1: 3, 2: 1, 3: 0}
    depth, directory = exact_dedup.build_directory(counts, 1000, 2)
    assert depth == 2 and exact_dedup.deeper_bits(counts, 1000, depth, directory, 2) == [3, 0, 0, 0]


def test_exact_tells_colliding_keys_apart(odd, monkeypatch):
    batch = [(1, b"x", 1, b"p", 1, 1), (1, b"y", 2, b"p", 1, 1), (1, b"x", 0, b"q", 2, 3), (1, b"x", 0, b"q", 1, 1), (2, b"z", None, b"a", 1, 1), (2, b"z", 9, b"b", 1, 1)]
    import pyarrow as pa

    kinds = {"key": pa.int64(), "norm": pa.binary(), "low_id": pa.int64(), "low_raw": pa.binary(), "n_low": pa.int64(), "n": pa.int64()}
    data = pa.record_batch([pa.array(c, t) for c, t in zip(zip(*batch, strict=True), kinds.values(), strict=True)], list(kinds))
    got = [r for b in exact_dedup._chain(iter([data])) for r in b.to_pylist()]
    assert [(r["key"], r["link"], r["keep_id"], r["n_keep"], r["group_size"]) for r in got] == [(1, 0, 0, 3, 5), (1, 1, 2, 1, 1), (2, 0, 9, 1, 2)]


def test_directory_doubles_and_splits():
    counts = {p: 1 for p in range(16)} | {0: 100}
    depth, directory = exact_dedup.build_directory(counts, 10, 4)
    assert len(directory) == 2**depth
    for cell, (prefix, local) in enumerate(directory):
        assert cell >> (depth - local) == prefix
    loads = Counter()
    for p, n in counts.items():
        loads[directory[p >> (4 - depth)]] += n
    assert all(n <= 10 or b[1] == 4 for b, n in loads.items())
    assert exact_dedup.build_directory({}, 10, 4) == (0, [(0, 0)])


# -- suffix dedup


def brute_suffix(docs, length=200):
    raw = [(t or "").encode() for _, t in docs]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    for (d, _), b in zip(docs, raw, strict=True):
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        yield d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()


def patched(n=60, seed=3):
    rng = random.Random(seed)
    blocks = ["".join(rng.choice("abé cd") for _ in range(rng.choice([190, 199, 200, 201, 260, 900]))) for _ in range(10)]
    out = []
    for i in range(n):
        t = ""
        for _ in range(rng.randint(0, 4)):
            t += rng.choice(blocks)[rng.choice([0, 0, 3, 50]) : rng.choice([999, 999, 230, 300])] + "".join(rng.choice("abé cd") for _ in range(rng.choice([0, 1, 5, 100])))
        out.append((i, t))
    return out


def test_suffix(spark, odd, empty):
    for df in (spark.createDataFrame(patched(), "doc_id long, text string").repartition(3), odd.where("length(text) < 5000 or text is null")):
        same(suffix_dedup.repeated_bytes(df), brute_suffix(pairs(df)))
    assert suffix_dedup.repeated_bytes(empty).isEmpty()
    cut = suffix_dedup.cut_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    short = {r.doc_id: r.text for r in cut.where("doc_id < 8").collect()}
    assert short[0] is None and short[5] == "a b c"


def test_suffix_splits_long_texts(spark, monkeypatch):
    rng = random.Random(1)
    word = "".join(rng.choice("abcdef") for _ in range(2500))
    offs = np.array([0, 2500])
    data = np.frombuffer(word.encode(), np.uint8)
    whole = suffix_dedup.sampled_runs(offs, data, 200)
    monkeypatch.setattr(suffix_dedup, "_PIECE", 700)
    windows = []
    for _, starts, part, base in suffix_dedup._pieces(offs, data, 200):
        first, more, _, _ = suffix_dedup.sampled_runs(starts, part, 200)
        windows += [base + f + k for f, m in zip(first, more, strict=True) for k in range(m + 1)]
    assert windows == list(range(2500 - 199))
    assert int((whole[1] + 1).sum()) == 2500 - 199


def test_suffix_of_texts_in_several_pieces(spark):
    rng = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnop", np.uint8)
    size = suffix_dedup._PIECE + 500_000

    def split_between_runs(text):
        """Without some first bytes, so that a new run starts with the second piece and no window there is refined."""
        near = text[suffix_dedup._PIECE - 1000 :][:3000]
        first = suffix_dedup.sampled_runs(np.array([0, len(near)]), near, 200)[0]
        return text[int(first[first >= 1000][0]) - 1000 :][:size].copy()

    short = letters[rng.integers(0, 16, 5_000)]
    long_text, late = (split_between_runs(letters[rng.integers(0, 16, size + 1000)]) for _ in range(2))
    passages = [letters[rng.integers(0, 16, 230)] for _ in range(4)]
    # Repeats in the short text, in the first piece, in the second, and from one to the other; only in the second of `late`.
    places = [(short, 0, (700, 3_000)), (long_text, 1, (1_000, 2_000_000)), (long_text, 2, (size - 400_000, size - 1_000)), (long_text, 3, (50_000, size - 90_000)), (late, 3, (size - 70_000,))]
    gone = {id(t): np.zeros(len(t), bool) for t in (short, long_text, late)}
    edges = iter(range(65, 91))
    for text, k, starts in places:
        for at in starts:
            text[at : at + 230] = passages[k]
            text[at - 1], text[at + 230] = next(edges), next(edges)  # no repeat is longer by chance
            gone[id(text)][at : at + 230] = True
    texts = [short, long_text, late]
    docs = spark.createDataFrame([(i, t.tobytes().decode()) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    truth = [(i, len(t), int(gone[id(t)].sum()), int(gone[id(t)].sum()) // 230, hashlib.sha256(t[~gone[id(t)]].tobytes()).hexdigest()) for i, t in enumerate(texts)]
    same(suffix_dedup.repeated_bytes(docs), truth)


# -- Jaccard join


def brute_sets(docs):
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        yield frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_near(docs):
    sets = list(brute_sets(docs))
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    for i, (d, _) in enumerate(docs):
        yield d, len(sets[i]), low.get(find(i)) if sets[i] else d


def near_copies(n=150, seed=5):
    """Chains of edits around the threshold, and a passage that many others share."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(80)]
    passage = " ".join(f"p{i}" for i in range(30))
    out = []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(7)):
            words[rng.randrange(80)] = f"e{rng.randrange(40)}"
        if i % 3 == 0:
            words = [f"u{i}-{k}" for k in range(rng.randrange(3, 60))] + passage.split()
        out.append((i, " ".join(words)))
    return out


def test_near(spark, odd, empty, documents, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 16)  # many blocks to a region
    for df in (spark.createDataFrame(near_copies(), "doc_id long, text string").repartition(3), odd):
        same(jaccard.near_duplicates(df), brute_near(pairs(df)))
    monkeypatch.undo()
    same(jaccard.near_duplicates(documents), brute_near(pairs(documents)))
    assert jaccard.near_duplicates(empty).isEmpty()
    kept = jaccard.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {0, 1, 2, 3, 17, 18, None}


def test_few_words_alone(spark):
    for n in range(7):
        text = " ".join("abcdefg"[:n])
        data = np.frombuffer(text.encode(), np.uint8)
        offs, hashes = common.shingle_sets(data, np.array([0, len(data)]))
        truth = [len(s) for s in brute_sets([(0, text)])]
        assert np.diff(offs).tolist() == truth and len(hashes) == truth[0]
    for n in (1, 2, 3, 4):
        one = spark.createDataFrame([(7, " ".join("abcd"[:n]))], "doc_id long, text string")
        same(jaccard.near_duplicates(one), [(7, 1, 7)])


def test_thue_morse_words_are_apart(spark):
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    df = spark.createDataFrame([(1, word), (2, other), (3, " ".join([word, other] * 3)), (4, " ".join([other, word] * 3))], "doc_id long, text string")
    same(jaccard.near_duplicates(df), brute_near(pairs(df)))
    same(suffix_dedup.repeated_bytes(df), brute_suffix(pairs(df)))


def region(rng, n, core=0.5):
    """Sets around one centre: some within the link distance of it, the others in clusters farther out."""
    centre = rng.choice(1 << 40, 200, replace=False)
    rims = [np.concatenate([centre[: int(rng.integers(60, 150))], rng.choice(1 << 40, 100, replace=False)]) for _ in range(6)]
    out = []
    for _ in range(n):
        base = centre if rng.random() < core else rims[rng.integers(len(rims))]
        kept = base[rng.random(len(base)) > 0.12 * rng.random()]
        out.append(np.unique(np.concatenate([kept, rng.choice(1 << 40, int(rng.integers(0, 12)), replace=False)])).astype(np.uint64))
    return out


def test_cells_join_exactly():
    rng = np.random.default_rng(3)
    for n, core in ((30, 0.5), (400, 0.5), (400, 0.0), (400, 1.0), (800, 0.3)):
        sets = region(rng, n, core)
        got = jaccard.cell_links(sets, np.ones(n, bool), np.zeros(n, bool), leaf=16, pivots=4)
        shared = jaccard._dense_overlaps(sets, sets)
        sizes = np.array([len(s) for s in sets])
        linked = 100 * shared >= 80 * (sizes[:, None] + sizes[None, :] - shared)
        assert all(linked[i, j] for i, j in got)
        root, truth = list(range(n)), list(range(n))

        def find(r, x):
            while r[x] != x:
                x = r[x]
            return x

        for i, j in got:
            root[find(root, i)] = find(root, j)
        for i, j in zip(*np.nonzero(linked), strict=True):
            truth[find(truth, i)] = find(truth, j)
        parts = lambda r: {frozenset(k for k in range(n) if find(r, k) == x) for x in {find(r, k) for k in range(n)}}
        assert parts(root) == parts(truth)


def test_large_regions_split(spark):
    rng = np.random.default_rng(5)
    sets = region(rng, 800, 0.4)
    docs = [(i, " ".join(f"x{t}" for t in s.tolist())) for i, s in enumerate(sets)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    nodes, texts = jaccard.shingle_nodes(df)
    parts = []
    for weight in (jaccard.CELL, 20_000):
        roots = components.connected_components(jaccard.near_links(texts, nodes, weight))
        named = nodes.join(roots, "node", "left").select("doc_id", F.hex(F.coalesce("root", "node")).alias("root")).collect()
        groups = defaultdict(set)
        for r in named:
            groups[r.root].add(r.doc_id)
        parts.append(set(map(frozenset, groups.values())))
    assert parts[0] == parts[1] and len(parts[0]) > 6
    truth = defaultdict(set)
    for d, _, c in brute_near(docs):
        truth[c].add(d)
    assert parts[0] == set(map(frozenset, truth.values()))


def test_components(spark):
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5), (None, 3)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


# -- urls


def brute_url(url):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)(\?[^#]*)?", url or "")
    low = lambda x: re.sub("[A-Z]", lambda c: c[0].lower(), x or "")
    host, path, query = (low(m[1]), m[2], m[3]) if m else ("", "", "")
    best = None
    for said, h, p in url_filter.DOMAIN_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, said)
    text = (host + low(path) + low(query)).encode()
    glob = lambda g: re.fullmatch(b"".join({"*": b".*", "?": b"."}.get(c) or re.escape(c.encode()) for c in g), text, re.S)
    return host, path, best[0] if best else None, best[1] if best else "block" if any(map(glob, url_filter.BLOCK_GLOBS)) else "allow"


def test_urls(spark):
    urls = [r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    urls += [None, "", "x", "://", "http://", "HTTP://EXAMPLE.com/en/7x", "a://com/en/", "a://notcom/en/", "a://b.example.net/de/8", "a://b.example.net/de/9?q#f", "a://h\n/p", "http://ads-x.org/a", "http://q.xxx/", "a://b://c/d", "a://é.com/ü.exe#x", "a://x/" + "y" * 5000 + ".zip"]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in enumerate(urls)], "page_id long, url string, host string, path string")
    same(url_filter.judge_urls(df).drop("glob_hit"), [(i, *brute_url(u)) for i, u in enumerate(urls)])
    assert url_filter.judge_urls(df.limit(0)).isEmpty()


def test_globs_across_words():
    globs = ["a*b?c", "*" + "x" * 90, "?" * 70, "lit", "*", "", "**z"][:4] + ["q**r"]
    texts = [b"", b"abc", b"azzbxc", b"x" * 90, b"y" + b"x" * 90, b"x" * 89, b"k" * 70, b"lit", b"light", b"qr", b"q12r", b"ab?c"]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = url_filter.run_globs(url_filter.compile_globs(globs), offs, np.frombuffer(b"".join(texts), np.uint8))
    truth = [any(re.fullmatch("".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in g).encode(), t) for g in globs) for t in texts]
    assert got.tolist() == truth


# -- top-k


def test_topk(spark):
    rng = np.random.default_rng(4)
    vectors = np.round(rng.normal(size=(400, 8)), 2).astype(np.float32)
    vectors[100:250] = vectors[100]
    data = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    data += [(400, None), (500, [float("nan")] + [0.0] * 7), (600, [None] + [1.0] * 7), (700, [1.0]), (None, [1.0] * 8), (30, [float(x) for x in vectors[31]])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 100 = 0")
    good = [(i, np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(np.int64)) for i, v in data if i is not None and v and len(v) == 8 and None not in v and np.isfinite(v).all()]
    truth = []
    for q, v in good:
        if q % 100 == 0:
            best = sorted((-int(v @ w), i) for i, w in good if i != q)[:10]
            truth += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    for shard_rows in (60, 10_000):
        same(topk.top_k(df, asked, shard_rows=shard_rows, block_rows=2), truth)
    assert topk.top_k(df.limit(0), asked.limit(0)).isEmpty()
    assert topk.top_k(df.limit(0), asked).isEmpty() and topk.top_k(df, asked.limit(0)).isEmpty()
    assert topk.top_k(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2
    clash = df.withColumns({c: F.lit("z") for c in ("id", "v", "shard", "block", "floor", "score", "rank", "cell", "query_id")})
    same(topk.top_k(clash, clash.where("vec_id % 100 = 0"), shard_rows=60), truth)
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e18, 2.0])], "vec_id long, embedding array<double>"), spark.createDataFrame([(0, [1e18, 1.0])], "vec_id long, embedding array<double>")).collect()


def test_cells_prune_what_lies_apart(spark):
    rng = np.random.default_rng(9)
    groups = rng.normal(size=(12, 16)) * 4
    vectors = np.concatenate([g + rng.normal(size=(60, 16)) * 0.05 for g in groups])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    ints = np.floor(1024 * vectors).astype(np.int64)
    truth = []
    for q in range(0, len(ints), 100):
        best = sorted((-int(ints[q] @ v), i) for i, v in enumerate(ints) if i != q)[:10]
        truth += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    same(topk.top_k(df, df.where("vec_id % 100 = 0"), shard_rows=40), truth)
    placed, cells = topk._cells(df.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: F.floor(e * 1024)).alias("v")), len(ints), 60)
    queries = ints[::100].astype(np.float64)
    kth = np.array([-sorted(-(ints @ q))[9] for q in ints[::100]])
    assert placed.count() == len(ints)
    assert (cells.bounds(queries) >= kth[:, None]).mean() < 0.7  # pairs of a query and a cell that must be searched


# -- toxicity


def test_toxicity(spark, documents, odd, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels, max_train_rows=3000)
    assert len(model.slots) < 5000  # L1 leaves few weights
    got = toxicity.score_texts(docs, model).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in got if r.toxic == 1]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert sum(toxic) / len(toxic) > 0.75 and sum(clean) / len(clean) < 0.01
    for r in got[:20]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    scored = toxicity.score_texts(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id in (0, 1, 2)}) == 1
    assert toxicity.score_texts(empty, model).isEmpty()
    kept = toxicity.drop_toxic(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()  # nothing learned, nothing dropped
    assert toxicity.fit_ftrl([(1, np.array([1]))] * 3).intercept > 5


def plain_ftrl(docs, labels, bits, alpha=1.0, beta=1.0, l1=6.0, l2=0.1, passes=4, least=3, rows=8000, row_slots=16_384):
    """The same model with plain loops: (intercept, weight by slot)."""
    mask = (1 << 64) - 1

    def join(h, x):
        h = h * 0x9FB21C651E98DF25 & mask
        h ^= h >> 35
        h = (h + x) * 0xD6E8FEB86659FD93 & mask
        return h ^ h >> 32

    def mix(h):
        h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
        h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
        return h ^ h >> 31

    def word(w):
        h = len(w)
        for i in range(0, len(w), 8):
            h = join(h, int.from_bytes(w[i : i + 8], "little"))
        return mix(h)

    def slots(text):
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
        words_ = [word(w) for w in re.findall(rb"[0-9a-z\x80-\xff]+", raw)]
        a, b, c = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3
        grams = words_ + [mix(x * a + y * c & mask) for x, y in zip(words_, words_[1:], strict=False)] + [mix(x * b + y * c & mask) for x, y in zip(words_, words_[2:], strict=False)]
        return sorted({g >> 64 - bits for g in grams})[:row_slots]

    examples = [(y, slots(docs[i])) for i, y in labels][:rows]
    count = Counter(s for _, x in examples for s in x)
    z, n, bz, bn = defaultdict(float), defaultdict(float), 0.0, 0.0
    weight = lambda s: 0.0 if abs(z[s]) <= l1 else -(z[s] - math.copysign(l1, z[s])) / ((beta + math.sqrt(n[s])) / alpha + l2)
    for _ in range(passes):
        for y, x in examples:
            x = [s for s in x if count[s] >= least]
            w = [weight(s) for s in x]
            b = -bz / ((beta + math.sqrt(bn)) / alpha)
            g = 1 / (1 + math.exp(-min(30.0, max(-30.0, sum(w) + b)))) - y
            for s, v in zip(x, w, strict=True):
                z[s] += g - (math.sqrt(n[s] + g * g) - math.sqrt(n[s])) / alpha * v
                n[s] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / alpha * b
            bn += g * g
    return -bz / ((beta + math.sqrt(bn)) / alpha), {s: weight(s) for s in list(z) if weight(s)}


def test_toxicity_equals_plain_ftrl(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)  # production settings
    texts = dict(pairs(docs))
    allowed = labels.where("toxic is not null").select("doc_id", "toxic", F.xxhash64(F.col("doc_id").cast("long")).alias("h")).collect()
    known = sorted((r.h, r.doc_id, r.toxic) for r in allowed if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.doc_id in texts)
    intercept, weights = plain_ftrl(texts, [(d, int(y != 0)) for _, d, y in known], model.bits)
    assert abs(model.intercept - intercept) < 1e-6
    got = dict(zip(model.slots.tolist(), model.weights.tolist(), strict=True))
    for s in set(got) | set(weights):
        assert abs(got.get(s, 0) - weights.get(s, 0)) < 1e-4
    assert weights
    # Ids that repeat, texts that are null or long: one row an id, a bounded number of features.
    df = spark.createDataFrame([(1, "bad word"), (1, "a"), (3, None), (4, " ".join(f"w{i}" for i in range(9000)))], "doc_id long, text string")
    some = spark.createDataFrame([(1, 1), (3, 0), (4, 0)], "doc_id long, toxic int")
    assert toxicity.train(df, some, max_row_slots=100, l1=0.0, least_rows=1).weights.size <= 102


# -- licences


def test_licenses(spark, odd, empty, documents):
    def brute(text):
        raw = (text or "").encode()
        lines = raw.split(b"\n")
        found = []
        for unit in lines if len(lines) == 1 else [*lines, raw]:
            scored = [(licenses.dice(licenses.bigrams(unit), licenses.bigrams(t.encode())), n) for n, t in licenses.TEMPLATES]
            fits = [x for x in scored if x[0] >= 0.9]
            if fits:
                found.append(min(fits, key=lambda x: (-x[0], x[1])))
        best = min(found, key=lambda x: (-x[0], x[1])) if found else (0.0, None)
        return len(found), ",".join(sorted({n for _, n in found})), best[1], best[0]

    extra = [(900, "Licensed under the MIT License."), (901, "text\nLICENSED UNDER CC BY-NC 4.0\nmore"), (902, "All rights reserved."), (903, "licensed under the mit license " * 50)]
    df = spark.createDataFrame(pairs(odd) + extra + pairs(documents), "doc_id long, text string")
    got = licenses.scan_licenses(df)
    same(got, [(d, *brute(t)) for d, t in pairs(df)])
    said = {r.doc_id: r.best_license for r in got.where("doc_id between 900 and 902").collect()}
    assert said == {900: "MIT", 901: "CC-BY-NC-4.0", 902: "proprietary"}
    assert licenses.scan_licenses(empty).isEmpty()


def test_license_passages(spark, odd, empty):
    full, header = dict(licenses.full_texts()), dict(licenses.HEADERS)
    wrapped = "\n".join("# " + " ".join(header["Apache-2.0"].split()[i : i + 9]) for i in range(0, 80, 9))
    said = [
        ("import os\n" + wrapped + "\nprint(1)", "Apache-2.0", 1),
        ('# Licensed under the Apache License, Version 2.0 (the "License");', "Apache-2.0", 1),
        ("MIT License\n\nCopyright (c) 2024 Foo\n\n" + full["MIT"] + "\nand then some prose", "MIT", 1),
        (" ".join(full["MIT"].split("\n\n")[0].split()), "MIT", 1),
        ("Copyright (c) 2024 Foo Inc. All rights reserved.", "proprietary", 1),
        ("This code is free. Licensed under the MIT License. See LICENSE.", "MIT", 1),
        ("It says: this work is licensed under the GNU General Public License, version 3, as all know.", "GPL-3.0", 1),
        ("x " * 500 + full["GPL-3.0"] + "y " * 500, "GPL-3.0", 1),
        ("licensed under the mit license " * 50, "MIT", 50),
        ("licensed under\n the plain licence of no one", None, 0),
        ("Licensed under the MIT", None, 0),
        ("License.", None, 0),
    ]
    df = spark.createDataFrame([(i, x[0]) for i, x in enumerate(said)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r for r in licenses.scan_passages(df).collect()}
    assert [(got[i].best_license, got[i].n_matches) for i in range(len(said))] == [x[1:] for x in said]
    for i, (_, name, _) in enumerate(said):
        assert set(filter(None, got[i].licenses.split(","))) == ({name} if name else set())
    assert licenses.scan_passages(odd).count() == odd.count() and licenses.scan_passages(empty).isEmpty()


def test_license_windows_by_brute_force():
    rng = random.Random(6)
    small = [("A", "one two three 2.0 four"), ("B", "one two three 2.0 five six seven eight nine ten eleven twelve"), ("C", "v1.2b three")]
    words = sorted({w for _, t in small for w in t.split()}) + ["x", ".5", "2", "Ünï", "a.1.2c"]
    texts = []
    for _ in range(300):
        parts = [rng.choice([t for _, t in small] + [rng.choice(words)] * 4) for _ in range(rng.randrange(12))]
        texts.append(rng.choice([" ", "\n", " # "]).join(parts).replace(rng.choice(words), rng.choice(words)))
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    start, end, row = licenses._tokens(offs, licenses.LOWER[data])
    got = licenses.Passages(small, 0.9).find(offs, data)
    for i, text in enumerate(raw):
        spans = [m.span() for m in licenses._WORD.finditer(text.lower())]
        assert [(int(a - offs[i]), int(b - offs[i])) for a, b in zip(start[row == i], end[row == i], strict=True)] == spans
        truth = []
        for name, template in small:
            grams, n = licenses.bigrams(template.encode()), len(licenses._WORD.findall(template.encode()))
            windows = [(-licenses.dice(licenses.bigrams(text[spans[k][0] : spans[k + n - 1][1]]), grams), k) for k in range(len(spans) - n + 1)]
            taken = []
            for d, k in sorted(w for w in windows if -w[0] >= 0.9):
                if all(abs(k - x) >= n for x in taken):
                    taken.append(k)
                    truth.append((-d, name, int(offs[i]) + spans[k][0], int(offs[i]) + spans[k + n - 1][1]))
        assert sorted(got.get(i, [])) == sorted(truth)


# -- tokens


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


TRICKY = ["It's  A<|endoftext|>b <|startoftext|>", "a\x1cb \x85c\xa0d\u200be\u2003f", "ΑΣ ΣΑΣ. İstanbul ǅ ﬁ", "é ́x å", "don't'll 'RE 's", "ẞ ß Å Ω \x7f\x01", "😀👨‍👩 x", "a.,b;;c 1²3 ½"]


def test_encode_and_decode(spark, odd, empty, documents, library):
    df = spark.createDataFrame(pairs(odd) + list(enumerate(TRICKY, 800)) + pairs(documents), "doc_id long, text string")
    ids = {}
    truth = []
    for d, t in pairs(df):
        ids[d, t] = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids[d, t], skip_special_tokens=False)
        truth.append((d, len(ids[d, t]), hashlib.sha256(" ".join(map(str, ids[d, t])).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    same(tokens.token_digests(df), truth)
    assert tokens.token_digests(empty).isEmpty()
    coded = tokens.encode(df.where("doc_id >= 800"))
    assert {r.doc_id: list(r.ids) for r in coded.collect()} == {d: i for (d, _), i in ids.items() if d is not None and d >= 800}
    back = {r.doc_id: r.text for r in tokens.decode(coded).collect()}
    assert back == {d: library.decode(i, skip_special_tokens=False) for (d, _), i in ids.items() if d is not None and d >= 800}


def test_units_are_the_librarys(library):
    rng = random.Random(12)
    letters = "aSétÀ×÷ª½²1 '\n\t.,!<|>ll're'Ve\xa0\x85İΣ日\u0301K\x1c"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["'s", "x'", "s", "'", "l'l", "'ll", "'l", ""]
    raw = [t.encode() for t in texts]
    offs = np.cumsum([0, *map(len, raw)])
    coder = tokens.vocabulary(tokens.default_vocabulary())
    low, start, end, row = words.units_in(offs, np.frombuffer(b"".join(raw), np.uint8))
    table = words.WordTable(lambda units: [(np.concatenate([np.array(e.ids, "<u4") for e in coder.tokenizer.encode_batch(units, add_special_tokens=False)]), [len(e.ids) for e in coder.tokenizer.encode_batch(units, add_special_tokens=False)])], ("<u4",), 50)
    for part in (slice(0, len(start) // 2), slice(len(start) // 2, None)):
        ids, at = table.gather(0, table.numbers(low, start[part], end[part]))
        for r in range(row[part][0] + 1, row[part][-1]):
            a, b = np.searchsorted(row[part], [r, r + 1])
            assert ids[at[a] : at[b]].tolist() == library.encode(texts[r], add_special_tokens=False).ids, texts[r]


def test_word_table_keeps_words_apart():
    rng = random.Random(8)
    pool = [bytes(rng.choices(b"ab\x00", k=rng.choice([1, 7, 8, 9, 15, 16, 17, 23, 24, 25, 40]))) for _ in range(400)]
    table = words.WordTable(lambda units: [(np.concatenate([np.frombuffer(u.encode(), np.uint8) for u in units]), np.array([len(u) for u in units]))], ("u1",), 100, 20_000)
    for _ in range(20):
        said = rng.choices(pool, k=300)
        end = np.cumsum([len(w) for w in said])
        start = end - [len(w) for w in said]
        values, at = table.gather(0, table.numbers(np.frombuffer(b"".join(said), np.uint8), start, end))
        assert [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] == said
        assert len(table) <= 101 + 300


def test_automaton_is_minimal(tmp_path):
    lexicon = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(["tap", "taps", "top", "tops", "stop", "stops", "", "é"])}
    path = tmp_path / "lexicon"
    path.write_bytes(tokens.pack_lexicon(lexicon))
    lex = tokens.Lexicon(str(path))
    number = lex.find([*lexicon, b"ta", b"tapsx", b"\xff", b"sto"])
    assert (number[len(lexicon) :] == -1).all() and sorted(number[: len(lexicon)]) == list(range(len(lexicon)))
    for w, n in zip(lexicon, number, strict=False):
        assert lex.ids[lex.starts[n] : lex.starts[n + 1]].tolist() == lexicon[w]
    edges, final, _ = tokens.build_automaton(sorted([b"tap", b"taps", b"top", b"tops"]))
    assert len(edges) == 5  # t, a|o, p, s: the endings are shared


def test_section_counts(spark, odd, empty, documents, library):
    for options in ({}, {"section_chars": 7}, {"section_chars": 7, "rule": "end"}, {"section_chars": 7, "rule": "most"}):
        df = spark.createDataFrame(list(enumerate(TRICKY, 800)) + pairs(documents)[:40] + [(1, ""), (2, None), (3, "a\n"), (4, "\n\n")], "doc_id long, text string")
        truth = []
        for d, t in pairs(df):
            t = t or ""
            size = options.get("section_chars")
            cuts = list(range(0, max(1, len(t)), size)) if size else [0] + [i + 1 for i, c in enumerate(t) if c == "\n" and i + 1 < len(t)]
            ends = [*cuts[1:], len(t)]
            n = [0] * len(cuts)
            for a, b in library.encode(t, add_special_tokens=False).offsets:
                over = [max(0, min(b, y) - max(a, x)) for x, y in zip(cuts, ends, strict=True)]
                first = max(k for k, x in enumerate(cuts) if x <= a)
                last = max(k for k, x in enumerate(cuts) if x <= max(a, b - 1))
                n[{"start": first, "end": last, "most": over.index(max(over)) if max(over) else first}[options.get("rule", "start")]] += 1
            truth += [(d, "run" if size else "line", k, x, y, c) for k, (x, y, c) in enumerate(zip(cuts, ends, n, strict=True))]
        same(tokens.section_token_counts(df, **options), truth)
    assert tokens.section_token_counts(empty).isEmpty()
    wide = odd.withColumns({c: F.lit("z") for c in ("section", "start", "end", "n_tokens", "kind", "piece", "length", "chunk", "nth", "number", "ids")})
    for make in (tokens.section_token_counts, tokens.token_digests, tokens.encode, packing.pack_documents, licenses.scan_passages):
        assert rows(make(wide).drop("sequence_id", "offset")) == rows(make(odd.select("doc_id", "text")).drop("sequence_id", "offset"))
    with pytest.raises(ValueError):
        tokens.section_token_counts(odd, rule="other")


# -- packing


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_plan_equals_one_by_one():
    rng = random.Random(9)
    for _ in range(40):
        capacity = rng.choice([7, 20, 100])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(120))]
        runs, used = packing.plan_best_fit(Counter(lengths), capacity)
        fill = defaultdict(list)
        for length, first, pieces, start, each, offset in runs:
            for j in range(pieces):
                fill[start + j // each].append((offset + j % each * length, length))
        for spans in fill.values():
            at = 0
            for offset, length in sorted(spans):
                assert offset == at
                at += length
        assert sorted(capacity - sum(n for _, n in s) for s in fill.values()) == best_fit(lengths, capacity)
        assert used == len(fill)


def test_capacity_tree():
    tree = packing.CapacityTree(13)
    there = set()
    rng = random.Random(3)
    for _ in range(300):
        c = rng.randrange(13)
        (there.discard if c in there else there.add)(c)
        tree.set(c, c in there)
        need = rng.randrange(14)
        assert tree.tightest(need) == min((x for x in there if x >= need), default=-1)


def test_packing(spark, odd, empty, documents, library):
    df = spark.createDataFrame(pairs(odd) + pairs(documents), "doc_id long, text string").repartition(4)
    got = packing.pack_documents(df, 512).collect()
    bins, docs = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
        docs[r.doc_id].append(r)
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 512
    expected, lengths = Counter(), []
    for d, t in pairs(df):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, a in enumerate(range(0, len(ids), 512)):
            part = ids[a : a + 512]
            expected[d, k, a, len(part), zlib.crc32(part.tobytes())] += 1
            lengths.append(len(part))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    assert len(bins) == len(best_fit(lengths, 512))
    assert packing.pack_documents(empty).isEmpty()


# -- queries as registered

SQL_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SQL_DIR):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SQL_DIR}/{f}'")
    got = queries.queries()[name](spark, SQL_DIR)
    truth = con.sql(sql.oracle_sql()[name])
    order = sorted(truth.columns)
    assert sorted(got.columns) == order
    assert rows(got.select(*order)) == sorted(map(repr, truth.select(*[f'"{c}"' for c in order]).fetchall()))


def test_other_queries_equal_brute_force(spark, library):
    docs = pairs(spark.read.parquet(f"{SQL_DIR}/documents.parquet"))
    named = queries.queries()
    same(named["op2_suffix_dedup"](spark, SQL_DIR), brute_suffix(docs))
    encoded = {d: library.encode(t or "", add_special_tokens=False) for d, t in docs}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    same(named["op9_bpe_transducer"](spark, SQL_DIR), [(d, len(e.ids), sha(" ".join(map(str, e.ids))), sha(library.decode(e.ids, skip_special_tokens=False))) for d, e in encoded.items()])
    counts = defaultdict(int)
    sections = 0
    for r in named["op10_token_counts"](spark, SQL_DIR).collect():
        counts[r.doc_id, r.kind] += r.n_tokens
        sections += r.kind == "run"
    assert dict(counts) == {(d, k): len(e.ids) for d, e in encoded.items() for k in ("line", "run")} and sections > len(docs)
    packed = named["op8_best_fit_packing"](spark, SQL_DIR).collect()
    assert sum(r.length for r in packed) == sum(len(e.ids) + 1 for e in encoded.values())
    lengths = [min(4096, n - a) for n in (len(e.ids) + 1 for e in encoded.values()) for a in range(0, n, 4096)]
    assert len({r.sequence_id for r in packed}) == len(best_fit(lengths, 4096))
    tox = {r.doc_id: r for r in named["op6_toxicity"](spark, SQL_DIR).collect()}
    assert set(tox) == {d for d, _ in docs} and all(r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in tox.values())
    assert named["op7_license_scan"](spark, SQL_DIR).count() == len(docs)


# -- pipeline and helpers


def test_pipeline_on_odd_and_empty_tables(spark, tmp_path):
    import corpus_pipeline

    base = [(d, t, lang, "s", n) for d, t, lang, _, n, *_ in odd_rows()]
    base += [(600, "kept twice", "en", "s", 10), (600, "another text", "en", "s", 12), (601, "kept twice", "en", "s", 10)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for name, data in (("odd", base), ("empty", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, schema).repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 0, 0)] if data else [], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        packed = corpus_pipeline.run(spark, folder).collect()
        if not data:
            assert packed == []
            continue
        docs = Counter(r.doc_id for r in packed if r.piece == 0)
        # Both texts of id 600 stay, and nothing of 601; of null and empty texts the first.
        assert docs[600] == 2 and 601 not in docs and docs[0] == 1 and 17 not in docs and docs[None] == 1



def test_pipeline_stages(spark, documents):
    import corpus_pipeline

    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    docs = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = pairs(docs)
        docs = common.materialize(stage(spark, docs, SF), "test-stage")
        assert docs.columns == documents.columns
        after = dict(pairs(docs))
        if name == "toxicity":
            assert sum(labels.get(d) == 0 and d not in after for d, _ in before) <= 2
        if name == "exact dedup":
            assert set(after) == {r[0] for r in brute_exact(before) if r[3]} and len(after) == docs.count()
        if name == "jaccard join":
            assert set(after) == {d for d, _, c in brute_near(before) if d == c}
        if name == "suffix dedup":
            sizes = {r[0]: r[1] - r[2] for r in brute_suffix(before)}
            assert set(after) == set(sizes)
            assert all(sizes[d] - 8 <= len(t.encode()) <= sizes[d] for d, t in after.items())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == set(after)


def test_membership_filter(spark):
    from dotloom.llm import exchange

    keys = [0, 1, -1, 5, 32768, 32769, 1 << 24, (1 << 24) - 1, -(1 << 40), 2**63 - 1]
    bits = exchange.membership_filter(spark.createDataFrame([(k,) for k in keys], "k long"), "k")
    assert exchange.may_hold(bits, np.array(keys)).all()
    others = np.array([2, 3, 4, 32767, 32770, 12345])
    assert not exchange.may_hold(bits, others).any()


def test_work_dir_needs_a_shared_folder(spark):
    class Conf(dict):
        pass

    class Session:
        conf = Conf({"spark.checkpoint.dir": "hdfs://host/shared/"})
        sparkContext = spark.sparkContext

    assert common.work_dir(Session, "x").startswith("hdfs://host/shared/x-")
    Session.conf = Conf()
    assert common.work_dir(Session, "x").startswith("file:")
    Session.sparkContext = type("Context", (), {"master": "yarn"})
    with pytest.raises(ValueError):
        common.work_dir(Session, "x")


def test_words_never_cross_rows():
    data = np.frombuffer(b"abc d", np.uint8)
    start, end, row = common.words_in(data, np.array([0, 2, 2, 5]), ~common.SPACE)
    assert list(zip(start, end, row, strict=True)) == [(0, 2, 0), (2, 3, 2), (4, 5, 2)]
    assert F.lit(1) is not None
