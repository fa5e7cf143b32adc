"""The client: sets over an operation log, with reads from a quorum of replicas."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import clock, handoff, read, repair, store
from .sources.oplog import OpLog

N, R, W = 3, 2, 2
OPTIONS = {"timeout", "recv_timeout", "ctx", "range_start", "range_end", "start_inclusive", "end_inclusive"}
_OPS = "op_id long, set_name string, element string, replica int, op string"
_DOTS = "op_id long, set_name string, element string, actor string, cnt long"


def context_dots(ctx, dictionary: dict[int, str] | None = None) -> list[tuple[str, int]]:
    """The dots of an element's context, in any of its forms.

    None and empty bytes: no context. A list of (actor, counter). Bytes: JSON of such a list, or, with a
    ``dictionary`` of actors by number, dots coded as length, number and counter.
    """
    if ctx is None or ctx in (b"", ""):
        return []
    if not isinstance(ctx, bytes):
        return [(a, int(n)) for a, n in ctx]
    if dictionary is None:
        return [(a, int(n)) for a, n in json.loads(ctx)]
    out, at = [], 0
    while at < len(ctx):
        size = int.from_bytes(ctx[at : at + 4], "big")
        body = ctx[at + 4 : at + 4 + size]
        out.append((dictionary[int.from_bytes(body[:4], "big")], int.from_bytes(body[4:], "big")))
        at += 4 + size
    return out


def _millis(name: str, value) -> float | None:
    if value is None or value == "infinity":
        return None
    if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
        raise ValueError(f"{name} must be a positive number of milliseconds or 'infinity': {value!r}")
    return value / 1000


def within(spark: SparkSession, seconds: float | None, action):
    """Runs an action; after ``seconds`` its jobs are cancelled and TimeoutError is raised."""
    if seconds is None:
        return action()
    group = f"dotloom-{uuid.uuid4().hex}"
    done: list = []

    def work():
        spark.sparkContext.setJobGroup(group, "bounded in time", interruptOnCancel=True)
        try:
            done.append((True, action()))
        except Exception as e:
            done.append((False, e))

    thread = InheritableThread(target=work, daemon=True)
    thread.start()
    thread.join(seconds)
    if not done:

        def cancel():  # again and again, for a job may only be about to start
            while thread.is_alive():
                spark.sparkContext.cancelJobGroup(group)
                thread.join(0.1)

        InheritableThread(target=cancel, daemon=True).start()
        raise TimeoutError(f"no answer within {seconds} s")
    fine, value = done[0]
    if fine:
        return value
    raise value


class CausalSets:
    """Reads, writes and upkeep of replicated add-wins sets; every answer is a lazy DataFrame."""

    path: str | None = None

    def __init__(self, spark: SparkSession, log: OpLog, quorum: tuple[int, ...] = (0, 1)):
        read.check_quorum(quorum, R)
        self.spark, self.log, self.quorum = spark, log, quorum

    @classmethod
    def empty(cls, spark: SparkSession) -> CausalSets:
        make = spark.createDataFrame
        return cls(spark, OpLog(make([], _OPS), make([], _DOTS + ", replica int"), make([], "op_id long, r int"), make([], _DOTS)))

    @classmethod
    def open(cls, spark: SparkSession, path: str, quorum: tuple[int, ...] = (0, 1)) -> CausalSets:
        """Sets whose log is kept below ``path``: updates append to it, and plans don't grow with them."""
        jvm = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/ops")
        if not jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
            cls.empty(spark).log.save(path)
        sets = cls(spark, OpLog.load(spark, path), quorum)
        sets.path = path
        return sets

    def save(self, path: str) -> CausalSets:
        """Write the log below ``path`` and go on with the sets kept there."""
        self.log.save(path)
        return CausalSets.open(self.spark, path, self.quorum)

    def update(self, set_name: str, adds: list = (), removes: list = (), ctx: dict | None = None, replica: int = 0, delivered: tuple[int, ...] = (0, 1, 2), dictionary: dict[int, str] | None = None) -> CausalSets:
        """The sets after an update: adds mint a dot each, and supersede their context's dots; removes only do the latter.

        Elements stand alone or as pairs (element, context). ``ctx`` maps elements to contexts, the dots that
        the caller has observed, in any form of context_dots(); an element without any is added
        blindly, and its removal does nothing.
        """
        if len(set(delivered)) < W or replica not in delivered:
            raise ValueError(f"a write needs its own replica and {W} in all: {delivered}")
        ctx = dict(ctx or {})
        paired = [x for x in (*adds, *removes) if not isinstance(x, str)]
        ctx |= dict(paired)
        adds, removes = ([x if isinstance(x, str) else x[0] for x in some] for some in (adds, removes))
        last = self.log.ops.agg(F.max("op_id").alias("m")).head()["m"]
        start = 0 if last is None else last + 1
        actor = f"r{replica}"
        used = self.log.clock.where((F.col("set_name") == set_name) & (F.col("actor") == actor)).agg(F.max("cnt").alias("m")).head()["m"] or 0
        ops, dots, seen = [], [], []
        for kind, elements in (("add", adds), ("remove", removes)):
            for element in elements:
                op = start + len(ops)
                observed = context_dots(ctx.get(element), dictionary)
                ops.append((op, set_name, element, replica, "remove" if kind == "remove" else "add_ctx" if observed else "add_blind"))
                seen += [(op, set_name, element, a, n) for a, n in observed]
                if kind == "add":
                    used += 1
                    dots.append((op, set_name, element, actor, used, replica))
        make = self.spark.createDataFrame
        delta = OpLog(make(ops, _OPS), make(dots, _DOTS + ", replica int"), make([(o[0], r) for o in ops for r in delivered], "op_id long, r int"), make(seen, _DOTS))
        if self.path:
            delta.save(self.path, "append")
            return CausalSets.open(self.spark, self.path, self.quorum)
        both = [getattr(self.log, name).unionByName(getattr(delta, name)) for name in OpLog.RELATIONS]
        return CausalSets(self.spark, OpLog(*both), self.quorum)

    def _live(self, set_name: str | None = None, quorum: tuple[int, ...] | None = None) -> DataFrame:
        quorum = quorum or self.quorum
        if self.log.wide is not None:
            live = read.wide_survivors(self.log.wide, quorum)
        else:
            live = read.survivors(self.log.held, self.log.clock, quorum)
        return live if set_name is None else live.where(F.col("set_name") == set_name)

    def read(self, set_name: str, **options) -> DataFrame:
        """(element, n_dots, dots) of the merged read; a set that nobody has is empty.

        The frame is lazy; ``timeout`` and ``recv_timeout`` count where it is fetched, see fetch(). ``ctx``, the
        dots that the caller knows, leaves out elements whose dots are all among them.
        """
        unknown = set(options) - OPTIONS - {"quorum"}
        if unknown:
            raise ValueError(f"unknown read options: {sorted(unknown)}")
        for name in ("timeout", "recv_timeout"):
            _millis(name, options.get(name))
        live = self._live(set_name, options.get("quorum"))
        bounds = read.in_range(live, options.get("range_start"), options.get("range_end"), options.get("start_inclusive", True), options.get("end_inclusive", True))
        known = context_dots(options.get("ctx"))
        if known:
            dots = F.broadcast(self.spark.createDataFrame(known, "actor string, cnt long"))  # the caller's own list
            news = bounds.join(dots, ["actor", "cnt"], "left_anti").select("set_name", "element")
            bounds = bounds.join(news.distinct(), ["set_name", "element"], "left_semi")
        return read.by_element(bounds).drop("set_name")

    def fetch(self, set_name: str, **options) -> list:
        """The rows of a read, in order; TimeoutError after the smaller of ``timeout`` and ``recv_timeout``."""
        limits = [t for t in (_millis(n, options.get(n)) for n in ("timeout", "recv_timeout")) if t]
        return within(self.spark, min(limits, default=None), lambda: self.read(set_name, **options).orderBy("element").collect())

    def write_read(self, set_name: str, sink, **options) -> None:
        """Hands a read's frame to ``sink(frame)`` which writes it where executors can, without the driver."""
        sink(self.read(set_name, **options))

    def bm_read(self, set_name: str, n: int = 10, **options) -> dict[str, int]:
        """Microseconds of n reads: max, min and avg."""
        times = []
        for _ in range(n):
            began = time.perf_counter()
            self.read(set_name, **options).write.format("noop").mode("overwrite").save()
            times.append(int((time.perf_counter() - began) * 1e6))
        return {"max": max(times), "min": min(times), "avg": sum(times) // len(times)}

    def stream_read(self, set_name: str, batch_size: int = 1000, **options) -> Iterator[list]:
        """Batches of elements in order; the driver holds a partition and the next."""
        if batch_size < 1:
            raise ValueError("batch_size must be at least 1")
        batch: list = []
        for row in self.read(set_name, **options).orderBy("element").toLocalIterator(prefetchPartitions=True):
            batch.append(row)
            if len(batch) == batch_size:
                yield batch
                batch = []
        if batch:
            yield batch

    def is_member(self, set_name: str, element: str) -> DataFrame:
        return self.members(set_name, [element])

    def members(self, set_name: str, elements: list[str]) -> DataFrame:
        """(element, is_member, n_dots, dots) for each distinct element asked for."""
        asked = self.spark.createDataFrame([(set_name, e) for e in elements], "set_name string, element string")
        return read.membership(self._live(set_name), asked).drop("set_name")

    def is_subset(self, set_name: str, elements: list[str]) -> DataFrame:
        """(element, n_dots, dots) of those of the elements that the set has."""
        return self.members(set_name, elements).where("is_member").drop("is_member")

    def has_all(self, set_name: str, elements: list[str]) -> DataFrame:
        """(set_name, is_subset)."""
        asked = self.spark.createDataFrame([(set_name, e) for e in elements], "set_name string, element string")
        return read.contains_all(self._live(set_name), asked)

    def repairs(self) -> DataFrame:
        return repair.read_repairs(self.log.held, self.log.clock, self.quorum)

    def clock(self, replica: int) -> DataFrame:
        """(set_name, actor, base, cloud)."""
        return clock.compress(self.log.clock_of(replica), ["set_name"])

    def keys(self, replica: int, layout: str = "nul") -> DataFrame:
        """The replica's store: rows of binary keys, for dumps, folds and sizes (see operators.store)."""
        return store.keys_of(self.log.held_of(replica), self.log.clock_of(replica), layout)

    def dump_set(self, replica: int, set_name: str) -> DataFrame:
        return store.dump_set(self.keys(replica), set_name)

    def drop_replica(self, replica: int) -> CausalSets:
        """The sets after a replica lost its store; a log kept in files stays as it is."""
        return CausalSets(self.spark, self.log.without_replica(replica), self.quorum)

    def handoff(self, sender: int, receiver: int) -> handoff.Handoff:
        return handoff.hand_off(self.log.held, self.log.clock, sender, receiver)

    def compact(self, sender: int, receiver: int) -> DataFrame:
        """The receiver's keys after a handoff and compaction."""
        h = self.handoff(sender, receiver)
        return handoff.compact(h.held, h.tombstone)[0]
