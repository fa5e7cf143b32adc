"""URL filters: all wildcard rules at once on a bit-parallel automaton.

Glob rules (``*`` any run, ``?`` any byte) over canonical urls are packed into multiword Shift-And
masks: each rule byte is one bit, a ``*`` makes the bit before it loop on every byte. One pass over
a url simulates every rule; urls of a batch advance together as rows of a word matrix.

Domain rules (host and path prefix, longest wins) decide first; the glob verdict is for the rest.

Defined results: a null url, or one without ``://``, has empty host and path, no rule, and the
glob verdict on the empty canonical url; repeated rows get a row each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of, tidy, views

#: (verdict, host, path prefix)
DOMAIN_RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Globs over the canonical url ``host + path + ?query``: adverts, gambling, adult, trackers, archives.
BLOCK_GLOBS = (
    "ads-*", "*.ads-*", "ads.*", "*.ads.*", "adserver*", "*.doubleclick.*", "*casino*", "*poker*", "*porn*", "xxx.*",
    "*.xxx/*", "track.*", "*.track.*", "*-track.*", "*/ads/*", "*/banner?/*", "*.exe", "*.zip", "*.apk", "*malware*", "*phish*", "*-win.*",
)


@dataclass(frozen=True)
class GlobAutomaton:
    """Shift-And masks of all rules, 63 state bits to a word; no rule crosses a word unless longer than it."""

    byte_masks: np.ndarray  # 256 x words
    starts: np.ndarray  # bits that the empty prefix reaches
    loops: np.ndarray  # bits of states that stay on any byte
    ends: np.ndarray  # accepting bits
    carries: bool


def compile_globs(globs) -> GlobAutomaton:
    """A state is a place between the letters of a rule; bit 0 of a rule is its start."""
    # Each rule takes one bit for its start and one for each letter.
    masks: list[tuple[int, int | None, bool]] = []  # (rule, byte or None for any, loops) for each state
    starts, ends = [], []
    for glob in globs:
        states: list[list] = [["start", False]]
        for c in glob.encode():
            if c == ord("*"):
                states[-1][1] = True
            else:
                states.append([None if c == ord("?") else c, False])
        starts.append(len(masks))
        masks += [tuple(s) for s in states]
        ends.append(len(masks) - 1)
    words = max(1, -(-len(masks) // 64))
    byte_masks = np.zeros((256, words), np.uint64)
    loops, end, start = (np.zeros(words, np.uint64) for _ in range(3))
    for i, (letter, loop) in enumerate(masks):
        w, bit = i // 64, np.uint64(1) << np.uint64(i % 64)
        if letter is None:
            byte_masks[:, w] |= bit
        elif letter != "start":
            byte_masks[letter, w] |= bit
        if loop:
            loops[w] |= bit
    for i in starts:
        start[i // 64] |= np.uint64(1) << np.uint64(i % 64)
    for i in ends:
        end[i // 64] |= np.uint64(1) << np.uint64(i % 64)
    return GlobAutomaton(byte_masks, start, loops, end, words > 1)


def run_globs(automaton: GlobAutomaton, offs: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Whether each url fits any rule. Urls go longest first, so those that have ended leave the matrix."""
    lengths = np.diff(offs)
    order = np.argsort(-lengths, kind="stable")
    begin = offs[:-1][order]
    sizes = lengths[order]
    state = np.tile(automaton.starts, (len(order), 1))
    one = np.uint64(1)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -k, side="left"))
        s = state[:live]
        step = s << one
        if automaton.carries:
            step[:, 1:] |= s[:, :-1] >> np.uint64(63)
        step &= automaton.byte_masks[data[begin[:live] + k]]
        state[:live] = step | (s & automaton.loops)
    hit = np.zeros(len(order), bool)
    hit[order] = (state & automaton.ends).any(axis=1)
    return hit


def _matcher(globs, column: str):
    def run(batches):
        automaton = compile_globs(globs)
        for batch in batches:
            text = text_of(batch.column(column))
            hits = [run_globs(automaton, offs, data) for _, offs, data in views(text, 1 << 19)]
            hit = np.concatenate(hits) if hits else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hit)], [*batch.schema.names, "glob_hit"])

    return run


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rules(rules, host: Column, path: Column) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule that fits; the rules are a short literal list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, where, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is outermost
        fits = ((host == where) | host.endswith("." + where)) & path.startswith(start)
        rule = F.when(fits, F.lit(where + start)).otherwise(rule)
        verdict = F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), domain_rules=DOMAIN_RULES, block_globs=BLOCK_GLOBS) -> DataFrame:
    """``keep`` columns and host, path, rule, verdict, glob_hit for each row.

    The canonical url that globs see is host, path and query without scheme and fragment,
    A-Z lower-cased.
    """
    url = F.col(url_col)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    base = pages.select(*[F.col(c) for c in keep], host_of(url).alias("host"), path_of(url).alias("path"), query.alias("__query"))
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    base = base.select(*keep, "host", "path", F.concat("host", lower(F.col("path")), lower(F.col("__query"))).alias("__canonical"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + ", glob_hit boolean"
    hit = base.mapInArrow(tidy(_matcher(tuple(block_globs), "__canonical")), schema)
    rule, verdict = _rules(domain_rules, F.col("host"), F.col("path"))
    glob_verdict = F.when(F.col("glob_hit"), "block").otherwise("allow")
    return hit.select(*keep, "host", "path", rule.alias("rule"), F.coalesce(verdict, glob_verdict).alias("verdict"), "glob_hit")
