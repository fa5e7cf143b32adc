"""BPE encoding and decoding through a minimal acyclic transducer lexicon, and token counts.

The vocabulary is a lower-casing word BPE in the format of the ``tokenizers`` library (its path is
a parameter). Its pre-tokens never span white space; whole views of texts are cut into them by vector
steps (``words.py``), and each distinct one is resolved once.

* Frequent words are found by mergeable heavy-hitter summaries over all documents, each of bounded
  size, and compiled into the smallest acyclic automaton that shares suffixes. Every edge carries
  the number of words before it, so the path of a word sums to the word's number, which points at
  its ids. The arrays are one file, published to all executors and memory-mapped there.
* A batch looks all its new units up at once (one vector step a byte). Those that the automaton
  doesn't hold are merged exactly by the vocabulary's merge table. A worker remembers a bounded number
  of units from batch to batch and task to task; that never changes a result.

Defined results: null is the empty text, which has no tokens; special tokens' strings in a text
are those tokens, as in the library; repeated rows get a row each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_of, tidy, work_dir
from .words import WordTable, gather, unit_views


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, int]:
    """Byte-level BPE shows each byte as a printable letter: printable Latin-1 as itself, the rest from U+0100 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in kept]
    return {b: 256 + k for k, b in enumerate(others)}


_BYTE_LETTERS = _byte_letters()

# -- the vocabulary and its words ---------------------------------------------------------------

#: The vocabulary's own pattern of pre-tokens.
_PRE_TOKENS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{L}\p{N}]+")  # words hold no white space


class Vocabulary:
    """The library's tokenizer with what is needed to work word by word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        self.strings = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.bytes_of = [len(x.removesuffix("</w>")) for x in self.strings]

    def pieces(self, word: str) -> list[str] | None:
        """The pre-tokens of a word below U+0250, in normal form; None: leave it to the library.

        Above, letters and their classes may differ between Unicode versions. Words that may hold a
        special token or white space beyond ASCII are the library's, too.
        """
        if "<|" in word or not word.isascii() and (max(word) >= "\u0250" or "\x85" in word or "\xa0" in word):
            return None
        if word.isascii() or max(word) < "\u0100":
            word = word.lower()
            if word.isalpha():
                return [word]
            if word[-1] in ".,;:!?)|" and word[:-1].isalpha():
                return [word[:-1], word[-1]]
        else:
            word = "".join([c.lower() for c in unicodedata.normalize("NFC", word)])
        return _PRE_TOKENS.findall(word)

    def merge(self, piece: str) -> list[int]:
        """Exact merges of one pre-token by the vocabulary's merge table."""
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return [t.id for t in self.tokenizer.model.tokenize(letters)]

    def library_ids(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        for a in range(0, len(words), 5000):
            out += [e.ids for e in self.tokenizer.encode_batch(words[a : a + 5000], add_special_tokens=False)]
        return out

    def spans(self, words: list[str]) -> list[tuple[list[int], list[int]]]:
        """Character starts and ends of each word's tokens, as the library's offsets."""
        out: list = [None] * len(words)
        hard: list[int] = []
        for i, word in enumerate(words):
            pieces = self.pieces(word)
            if pieces is None or sum(map(len, pieces)) != len(word):
                hard.append(i)
                continue
            starts: list[int] = []
            ends: list[int] = []
            at = 0
            for piece in pieces:
                sizes = [self.bytes_of[x] for x in self.merge(piece)]
                if piece.isascii():
                    for n in sizes:
                        starts.append(at)
                        at += n
                        ends.append(at)
                else:  # a token that holds part of a character spans all of it
                    owner = [k for k, c in enumerate(piece) for _ in c.encode()]
                    b = 0
                    for n in sizes:
                        starts.append(at + owner[b])
                        b += n
                        ends.append(at + owner[b - 1] + 1)
                    at += len(piece)
            out[i] = (starts, ends)
        for a in range(0, len(hard), 5000):
            part = hard[a : a + 5000]
            for i, e in zip(part, self.tokenizer.encode_batch([words[i] for i in part], add_special_tokens=False), strict=True):
                out[i] = ([x for x, _ in e.offsets], [y for _, y in e.offsets])
        return out


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One for each worker process."""
    if path not in _VOCABULARIES:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


# -- the transducer -----------------------------------------------------------------------------


def build_automaton(words: list[bytes]):
    """Smallest acyclic automaton of sorted, distinct words: (edges by state, accepting states, root).

    States are made from the last letters up, and a state equal to an earlier one is that one.
    """
    register: dict[tuple, int] = {}
    edges: list[dict[int, int]] = []
    final: list[bool] = []
    path: list[dict[int, int]] = [{}]  # open states along the last word
    accept = [False]
    last = b""

    def close(depth: int) -> None:
        while len(path) - 1 > depth:
            letters, end = path.pop(), accept.pop()
            key = (end, tuple(letters.items()))
            state = register.get(key)
            if state is None:
                state = register[key] = len(edges)
                edges.append(letters)
                final.append(end)
            path[-1][last[len(path) - 1]] = state

    for word in words:
        common = 0
        top = min(len(word), len(last))
        while common < top and word[common] == last[common]:
            common += 1
        close(common)
        for _ in word[common:]:
            path.append({})
            accept.append(False)
        accept[-1] = True
        last = word
    close(0)
    edges.append(path[0])
    final.append(accept[0])
    return edges, final, len(edges) - 1


def pack_lexicon(words: dict[bytes, list[int]]) -> bytes:
    """The lexicon file: a JSON header line, then aligned arrays."""
    order = sorted(words)
    edges, final, root = build_automaton(order)
    letters = sorted({c for e in edges for c in e})
    column = {c: i + 1 for i, c in enumerate(letters)}  # column 0: any other byte, no way on
    width = len(letters) + 1
    follow = np.full((len(edges), width), -1, np.int32)
    before = np.zeros((len(edges), width), np.int32)
    total = [0] * len(edges)
    for state, out in enumerate(edges):  # targets have smaller numbers
        seen = int(final[state])
        for c in sorted(out):
            follow[state, column[c]] = out[c]
            before[state, column[c]] = seen
            seen += total[out[c]]
        total[state] = seen
    classes = np.zeros(256, np.int32)
    for c, i in column.items():
        classes[c] = i
    flat = [words[w] for w in order]
    starts = np.zeros(len(flat) + 1, np.int32)
    np.cumsum([len(x) for x in flat], out=starts[1:])
    ids = np.array([i for x in flat for i in x], np.int32)
    arrays = {"classes": classes, "follow": follow.ravel(), "before": before.ravel(), "final": np.array(final, np.int32), "starts": starts, "ids": ids}
    head = json.dumps({"root": root, "width": width, "sizes": [[k, len(a)] for k, a in arrays.items()]}).encode()
    head += b" " * (-(len(head) + 1) % 4) + b"\n"
    return head + b"".join(a.astype("<i4").tobytes() for a in arrays.values())


class Lexicon:
    """A memory-mapped lexicon file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            line = f.readline()
        head = json.loads(line)
        whole = np.memmap(path, "<i4", "r", offset=len(line)).view(np.ndarray)  # still mapped
        at = 0
        for name, n in head["sizes"]:
            setattr(self, name, whole[at : at + n])
            at += n
        self.root, self.width = head["root"], head["width"]

    def find(self, words: list[bytes]) -> np.ndarray:
        """Each word's number, or -1; all words take one step a byte together."""
        n = len(words)
        number = np.zeros(n, np.int64)
        lengths = np.fromiter(map(len, words), np.int64, n)
        order = np.argsort(-lengths, kind="stable")
        begin = np.zeros(n, np.int64)
        np.cumsum(lengths[:-1], out=begin[1:])
        begin, sizes = begin[order], lengths[order]
        data = np.frombuffer(b"".join(words), np.uint8)
        kinds = self.classes[data] if len(data) else np.zeros(0, np.int32)
        state = np.full(n, self.root, np.int64)
        live = np.flatnonzero(sizes > 0)
        step = 0
        while len(live):
            cell = state[live] * self.width + kinds[begin[live] + step]
            state[live] = self.follow[cell]
            number[live] += self.before[cell]
            step += 1
            live = live[(state[live] >= 0) & (sizes[live] > step)]
        fine = state >= 0
        fine[fine] = self.final[state[fine]] > 0
        out = np.full(n, -1, np.int64)
        out[order] = np.where(fine, number, -1)
        return out


_LEXICONS: dict[str, Lexicon] = {}


def lexicon(name: str) -> Lexicon:
    if name not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[name] = Lexicon(SparkFiles.get(name))
    return _LEXICONS[name]


def publish(spark: SparkSession, content: bytes, tag: str) -> str:
    """Write a file to the shared folder and hand it to all executors; gives its name there."""
    path = f"{work_dir(spark, tag)}.bin"
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    for i in range(0, len(content), 1 << 20):
        out.write(bytearray(content[i : i + (1 << 20)]))
    out.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[1]


def _frequent(path: str, keep: int, prune_at: int):
    """A task's heavy hitters among pre-tokens: when too many words are held, those seen least go."""

    def run(batches):
        vocab = vocabulary(path)
        seen: Counter[bytes] = Counter()
        table, counts = WordTable(lambda units: (), (), prune_at), np.zeros(0, np.int64)

        def fold():
            seen.update({w: n for w, n in zip(table.words(), counts.tolist(), strict=False) if n})

        for batch in batches:
            for _, _, data, start, end, _ in unit_views(text_of(batch.column(0))):
                number = table.numbers(data, start, end)
                more = np.bincount(number, minlength=len(counts))
                more[: len(counts)] += counts
                counts = more
                if len(table) > prune_at:
                    fold()
                    table, counts = WordTable(lambda units: (), (), prune_at), np.zeros(0, np.int64)
                    low = 1
                    while len(seen) > prune_at:
                        seen = Counter({w: n for w, n in seen.items() if n > low})
                        low *= 2
        fold()
        pieces: Counter[str] = Counter()
        for w, n in seen.items():
            for piece in vocab.pieces(w.decode("utf-8", "replace")) or ():
                pieces[piece] += n
        top = [(w, n) for w, n in pieces.most_common(keep) if n > 1 and len(w) <= 64]
        yield pa.record_batch([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["word", "n"])

    return run


def build_lexicon(docs: DataFrame, text_col: str = "text", vocabulary_path: str | None = None, size: int = 65_536, prune_at: int = 200_000) -> str:
    """Compile the ``size`` most frequent words of all documents; gives the published file's name.

    A summary holds ``prune_at`` words at most and hands on ``size``; which words are held never
    changes a result, only how many must be merged.
    """
    path = vocabulary_path or default_vocabulary()
    counted = docs.select(F.col(text_col).alias("text")).mapInArrow(tidy(_frequent(path, size, prune_at)), "word string, n long")
    top = counted.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(size).collect()  # a stated bound
    return _compile(docs.sparkSession, path, [r.word for r in top])


def vocabulary_lexicon(spark: SparkSession, vocabulary_path: str | None = None) -> str:
    """Compile the vocabulary's own whole words, the frequent words of its training, without a pass over documents."""
    path = vocabulary_path or default_vocabulary()
    strings = vocabulary(path).strings
    return _compile(spark, path, [x.removesuffix("</w>") for x in strings if x.endswith("</w>") and x.isascii() and x[:-4].isalpha()])


def _compile(spark: SparkSession, path: str, words: list[str]) -> str:
    merge = vocabulary(path).merge
    return publish(spark, pack_lexicon({w.encode(): merge(w) for w in words}), "lexicon")


# -- encoding -----------------------------------------------------------------------------------


class Encoder(WordTable):
    """The ids of units: from the lexicon's automaton, else by merging."""

    def __init__(self, vocabulary_path: str, lexicon_name: str, remember: int = 400_000):
        self.vocab = vocabulary(vocabulary_path)
        self.lexicon = lexicon(lexicon_name)
        super().__init__(lambda units: [self.ids(units)], ("<u4",), remember)

    def _of_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        number = self.lexicon.find([p.encode() for p in pieces])
        unseen = np.flatnonzero(number < 0)
        merged = [self.vocab.merge(pieces[i]) for i in unseen.tolist()]
        starts = self.lexicon.starts.astype(np.int64)
        count = np.where(number < 0, 0, starts[number + 1] - starts[number])
        count[unseen] = np.fromiter(map(len, merged), np.int64, len(merged))
        known = number >= 0
        values = np.empty(int(count.sum()), "<u4")
        own = np.repeat(known, count)
        values[own] = gather(self.lexicon.ids, starts, number[known])[0]
        values[~own] = np.fromiter((x for ids in merged for x in ids), "<u4", int(count[unseen].sum()))
        return values, count

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All units' ids end to end, and how many each has."""
        split = list(map(self.vocab.pieces, units))
        hard = [i for i, p in enumerate(split) if p is None]
        whole = self.vocab.library_ids([units[i] for i in hard])
        place: dict[str, int] = {}
        parts = [place.setdefault(y, len(place)) for p in split if p is not None for y in p]
        values, count = self._of_pieces(list(place))
        # A hard unit counts as a piece of its own behind all others.
        edge = np.r_[0, np.cumsum(count), len(values) + np.cumsum(list(map(len, whole)))].astype(np.int64)
        values = np.concatenate([values, np.fromiter((x for ids in whole for x in ids), "<u4")])
        n = np.fromiter((1 if p is None else len(p) for p in split), np.int64, len(split))
        of_hard = np.zeros(len(units), bool)
        of_hard[hard] = True
        number = np.empty(int(n.sum()), np.int64)
        own = np.repeat(of_hard, n)
        number[own] = len(place) + np.arange(len(hard))
        number[~own] = parts
        flat, at = gather(values, edge, number)
        return flat, np.diff(at[np.r_[0, np.cumsum(n)]])

    def views(self, text: pa.Array):
        """(first row, ids of the view, where each row's start and the last's end) for views of a text column."""
        for first, _, data, start, end, edge in unit_views(text):
            ids, at = self.gather(0, self.numbers(data, start, end))
            yield first, ids, at[edge]


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, name: str) -> Encoder:
    """One for each worker process, which keeps the words that it has met from task to task."""
    if (path, name) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path, name] = Encoder(path, name)
    return _ENCODERS[path, name]


def _row_digests(data: np.ndarray, cuts: np.ndarray) -> list[str]:
    """SHA-256 of data[cuts[i]:cuts[i + 1]] without its last byte."""
    view = memoryview(data)
    return [hashlib.sha256(view[a : max(a, b - 1)]).hexdigest() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _spelt(parts) -> tuple[np.ndarray, np.ndarray]:
    """Each part's bytes and a space, end to end, and where they start and the last ends."""
    raw = [f"{p} ".encode() for p in parts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum(list(map(len, raw)))].astype(np.int64)


def _coded(path: str, name: str):
    def run(batches):
        coder, strings = encoder(path, name), vocabulary(path).strings
        spellings = _spelt(range(len(strings))), _spelt(strings)
        for batch in batches:
            for first, ids, edge in coder.views(text_of(batch.column(1))):
                columns = [batch.column(0).slice(first, len(edge) - 1), pa.array(np.diff(edge))]
                for flat, cuts in spellings:
                    data, at = gather(flat, cuts, ids.astype(np.int64))
                    columns.append(pa.array(_row_digests(data, at[edge]), pa.string()))
                yield pa.record_batch(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_digests(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary_path: str | None = None, lexicon_name: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode every text, keep the digests."""
    path = vocabulary_path or default_vocabulary()
    name = lexicon_name or build_lexicon(docs, text_col, path)
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pair.mapInArrow(tidy(_coded(path, name)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _encoded(path: str, name: str):
    def run(batches):
        for batch in batches:
            for first, ids, edge in encoder(path, name).views(text_of(batch.column(1))):
                lists = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.record_batch([batch.column(0).slice(first, len(edge) - 1), lists], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary_path: str | None = None, lexicon_name: str | None = None) -> DataFrame:
    """doc_id, ids array<int>."""
    path = vocabulary_path or default_vocabulary()
    name = lexicon_name or build_lexicon(docs, text_col, path)
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pair.mapInArrow(tidy(_encoded(path, name)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, text: the tokens' strings joined by a space, as the library decodes without a decoder.

    Null ids decode to the empty text; an unknown id adds nothing.
    """
    path = vocabulary_path or default_vocabulary()

    def run(batches):
        strings = vocabulary(path).strings
        for batch in batches:
            texts = [" ".join([strings[i] for i in ids or () if i is not None and 0 <= i < len(strings) and strings[i]]) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col)).mapInArrow(tidy(run), "doc_id long, text string")


# -- pieces for packing -------------------------------------------------------------------------


def _pieces(path: str, name: str, capacity: int, end_id: int):
    """Cuts each document's ids into pieces; ``chunk`` and ``nth`` number equal lengths inside a task."""

    def run(batches):
        from pyspark import TaskContext

        coder, chunk = encoder(path, name), TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for first, ids, edge in coder.views(text_of(batch.column(1))):
                ends = edge[1:] + np.arange(len(edge) - 1)  # places of the end ids
                whole = np.full(len(ids) + len(ends), end_id, "<u4")
                inner = np.ones(len(whole), bool)
                inner[ends] = False
                whole[inner] = ids
                begin = np.r_[0, ends[:-1] + 1]
                n = ends + 1 - begin
                parts = -(-n // capacity)
                row = np.repeat(np.arange(len(n)), parts)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                start = piece * capacity
                length = np.minimum(capacity, n[row] - start)
                view = memoryview(whole).cast("B")
                crc = [zlib.crc32(view[a:b]) for a, b in zip((4 * (begin[row] + start)).tolist(), (4 * (begin[row] + start + length)).tolist(), strict=True)]
                order = np.argsort(length, kind="stable")
                run_of = length[order]
                new = np.flatnonzero(np.r_[True, run_of[1:] != run_of[:-1]])
                nth = np.empty(len(row), np.int64)
                nth[order] = np.arange(len(row)) - np.repeat(new, np.diff(np.r_[new, len(row)])) + used[run_of]
                used += np.bincount(length, minlength=capacity + 1)
                docs = batch.column(0).slice(first, len(n)).take(pa.array(row))
                yield pa.record_batch(
                    [docs, pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(row), chunk)), pa.array(nth)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"],
                )

    return run


def token_pieces(docs: DataFrame, capacity: int, text_col: str = "text", id_col: str = "doc_id", vocabulary_path: str | None = None, lexicon_name: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and chunk, nth: a piece's number among its task's of that length."""
    path = vocabulary_path or default_vocabulary()
    name = lexicon_name or vocabulary_lexicon(docs.sparkSession, path)
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pair.mapInArrow(tidy(_pieces(path, name, capacity, end_id)), "doc_id long, piece int, start long, length long, ids_crc32 long, chunk long, nth long")


# -- token counts by section --------------------------------------------------------------------

RULES = ("start", "end", "most")


def allocate(starts: np.ndarray, ends: np.ndarray, cuts: np.ndarray, rule: str) -> np.ndarray:
    """The section of each token span; section k is cuts[k] up to cuts[k + 1].

    A token across a cut goes to the section of its first character (``start``), of its last
    (``end``), or to the one with most of its characters, the earlier if two have as many (``most``).
    """
    first = np.searchsorted(cuts, starts, side="right") - 1
    if rule == "start":
        return first
    last = np.searchsorted(cuts, np.maximum(ends - 1, starts), side="right") - 1
    if rule == "end":
        return last
    out = first.copy()
    across = np.flatnonzero(first != last)
    if len(across):  # all parts of these tokens, and the longest, earliest part of each
        parts = last[across] - first[across] + 1
        at = np.cumsum(parts) - parts
        section = np.repeat(first[across] - at, parts) + np.arange(parts.sum())
        low = np.maximum(np.repeat(starts[across], parts), cuts[section])
        high = np.minimum(np.repeat(ends[across], parts), np.append(cuts[1:], np.iinfo(np.int64).max)[section])
        order = np.lexsort((section, low - high, np.repeat(np.arange(len(across)), parts)))
        out[across] = section[order[at]]
    return out


def _section_starts(data: np.ndarray, offs: np.ndarray, letter: np.ndarray, section_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(row, first character in the view) of each section; ``letter`` has the characters before each byte."""
    rows = np.arange(len(offs) - 1)
    base = letter[offs]
    if section_chars:
        n = np.maximum(1, -(-np.diff(base) // section_chars))
        row = np.repeat(rows, n)
        return row, base[row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * section_chars
    after = np.flatnonzero(data == 10) + 1
    row = np.searchsorted(offs, after - 1, side="right") - 1
    inside = after < offs[row + 1]  # a line feed at the end starts no line
    row, at = np.concatenate([rows, row[inside]]), np.concatenate([base[:-1], letter[after[inside]]])
    order = np.lexsort((at, row))
    return row[order], at[order]


_SPANS: dict[str, WordTable] = {}


def _span_table(path: str, remember: int = 300_000) -> WordTable:
    """Units with their tokens' first and last characters; one for each worker process."""
    if path not in _SPANS:
        vocab = vocabulary(path)

        def resolve(units):
            spans = vocab.spans(units)
            count = np.fromiter((len(a) for a, _ in spans), np.int64, len(spans))
            return [(np.fromiter((i for x in spans for i in x[side]), "<i4", int(count.sum())), count) for side in (0, 1)]

        _SPANS[path] = WordTable(resolve, ("<i4", "<i4"), remember)
    return _SPANS[path]


def _section_counts(path: str, rule: str, kinds: tuple):
    def run(batches):
        table = _span_table(path)
        for batch in batches:
            for first, offs, data, start, end, edge in unit_views(text_of(batch.column(1))):
                number = table.numbers(data, start, end)
                letter = np.zeros(len(data) + 1, np.int64)
                np.cumsum((data & 0xC0) != 0x80, out=letter[1:])
                starts, at = table.gather(0, number)
                base = np.repeat(letter[start], np.diff(at))
                starts = base + starts
                # The rule `start` needs no ends.
                ends = starts if rule == "start" else base + table.gather(1, number)[0]
                for name, section_chars in kinds:
                    row, cuts = _section_starts(data, offs, letter, section_chars)
                    # A row without letters has a section, empty, that starts where the next row's first does: only that has tokens.
                    live = letter[offs[1:]][row] > letter[offs[:-1]][row]
                    counts = np.zeros(len(cuts), np.int64)
                    if live.any():
                        counts[live] = np.bincount(allocate(starts, ends, cuts[live], rule), minlength=int(live.sum()))
                    own = letter[offs[row]]
                    to = np.append(cuts[1:], letter[-1])
                    section = np.arange(len(row)) - np.searchsorted(row, row)
                    docs = batch.column(0).slice(first, len(offs) - 1).take(pa.array(row))
                    columns = [docs, pa.array([name] * len(row), pa.string()), pa.array(section.astype(np.int32)), pa.array(cuts - own), pa.array(to - own), pa.array(counts)]
                    yield pa.record_batch(columns, ["doc_id", "kind", "section", "start", "end", "n_tokens"])

    return run


def section_token_counts(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", vocabulary_path: str | None = None, rule: str = "start", section_chars: int | None = None, kinds: tuple | None = None
) -> DataFrame:
    """doc_id, kind, section, start, end, n_tokens: each text is encoded once, whole, with character offsets.

    Sections are lines (kind ``line``), or runs of ``section_chars`` characters (``run``); ``kinds``, pairs of
    a name and None or a number of characters, asks for several at once. The empty text has one section, empty.
    Counts of a kind's sections add up to the document's tokens, whatever the ``rule`` (see allocate()).
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kinds = kinds or ((("run", section_chars),) if section_chars else (("line", None),))
    path = vocabulary_path or default_vocabulary()
    pair = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return pair.mapInArrow(tidy(_section_counts(path, rule, kinds)), "doc_id long, kind string, section int, start long, `end` long, n_tokens long")
