"""The registered queries: each operator over the op log in ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, context, vv
from ..operators import clock, handoff, read, repair, state, stats, store
from ..sources import oplog, words
from ..sources.oplog import DOT, STATE, OpLog, events_log, ops_from_events

QUORUM = (0, 1)
RANGE = ("000010", "000050")
RANGE_SET = "click"
MEMBERS = [(s, f"{i:06d}") for s in ("click", "view") for i in range(0, 60, 3)] + [("click", "none"), ("absent", "000001"), ("click", "000003")]
DOTS = ["set_name", "element", "actor", "cnt"]
P = 64
RESTARTS = {1: [400, 700]}

_QUERIES: dict = {}


def query(f):
    """Register f(log) under its name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return f(events_log(spark, sf_dir))

    _QUERIES[f.__name__] = run
    return f


def _live(log: OpLog, quorum: tuple[int, ...] = QUORUM) -> DataFrame:
    return read.wide_survivors(log.wide, quorum)


def _clock(log: OpLog, r: int) -> DataFrame:
    return log.clock_of(r).select("set_name", "actor", "cnt")


def _where(log: OpLog, flag) -> DataFrame:
    """Dots of a wide log that a flag chooses: clock algebra over replicas is a filter there."""
    return log.wide.where(flag).select("set_name", "actor", "cnt")


def _packed_text(packed: DataFrame) -> DataFrame:
    """Cloud as its size and text, for comparison."""
    return packed.withColumn("n_gapped", F.size("cloud").cast("long")).withColumn("cloud", F.array_join(F.col("cloud").cast("array<string>"), ","))


def _spark(log: OpLog) -> SparkSession:
    return log.ops.sparkSession


# -- writes and replica state


@query
def assign_dots(log):
    return log.adds.select("op_id", "set_name", "element", "actor", "cnt")


@query
def actor_incarnations(log):
    """Dots when replica 1 lost its store twice: each time it is a new actor, whose counters start again."""
    return oplog.assign_dots(log.ops, restarts=RESTARTS).select("op_id", "set_name", "element", "actor", "cnt")


@query
def drop_replica(log):
    """What the replicas have seen and held after replica 1 was dropped."""
    left = OpLog(log.ops, log.adds, log.delivery, log.ctx).without_replica(1)
    seen, held = (x.groupBy("r", "set_name").agg(F.count("*").alias(n)) for x, n in ((left.clock, "n_seen"), (left.held, "n_held")))
    return seen.join(held, ["r", "set_name"], "left").select("r", "set_name", "n_seen", F.coalesce("n_held", F.lit(0)).cast("long").alias("n_held"))


@query
def visible_ctx(log):
    """The dots that a coordinator holds just before an operation with a context."""
    seen = oplog.visible_ctx(log.ops, log.adds, oplog.received)
    return seen.groupBy("op_id").agg(F.count("*").alias("n_dots"), read.dots_text().alias("dots"))


@query
def blind_remove(log):
    """A remove without context changes nothing: reads with and without such operations at the end of the log."""
    blind = log.ops.where("op = 'remove'").select((F.col("op_id") + (1 << 40)).alias("op_id"), "set_name", "element", "replica", "op")
    more = OpLog(log.ops.unionByName(blind), log.adds, log.delivery.unionByName(blind.select("op_id", F.col("replica").alias("r"))), log.ctx)
    return read.by_element(read.survivors(more.held, more.clock, QUORUM))


@query
def coordinator_routing(log):
    routed = state.coordinator(state.preflist(log.ops.select("op_id", "set_name"), F.col("op_id"), P), F.col("op_id") * 7)
    return routed.select("op_id", "coordinator", F.array_join(F.col("others").cast("array<string>"), ",").alias("others"))


@query
def observed_ctx(log):
    return log.ctx.groupBy("op_id").agg(F.count("*").alias("n_dots"), read.dots_text().alias("dots"))


@query
def replica_state(log):
    flags = [F.count(F.when(F.col(f"{kind}{r}"), 1)).alias(f"{kind}{r}") for r in (0, 1, 2) for kind in ("seen", "held")]
    return log.wide.groupBy("set_name").agg(*flags)


@query
def local_set_read(log):
    return read.by_element(log.held_of(0))


@query
def delta_join_idempotent(log):
    once_held, once_clock = state.delta_join(log.delivered_adds, log.removed)
    twice = (log.delivered_adds.unionByName(log.delivered_adds), log.removed.unionByName(log.removed))
    twice_held, twice_clock = state.delta_join(*twice)
    count = lambda df, name: df.groupBy("r").agg(F.count("*").alias(name))
    out = count(once_held, "held_once").join(count(twice_held, "held_twice"), "r").join(count(once_clock, "clock_once"), "r")
    return out.join(count(twice_clock, "clock_twice"), "r")


@query
def state_merge(log):
    keys, seen = state.state_merge(log.held), state.state_merge(log.clock)
    n = lambda df, name: df.groupBy("set_name").agg(F.count("*").alias(name))
    return n(keys, "n_keys").join(n(seen, "n_clock"), "set_name")


@query
def write_quorum(log):
    return state.write_acks(log.ops, log.delivery)


@query
def preflist_routing(log):
    out = state.preflist(log.ops.select("op_id", "set_name"), F.col("op_id"), P)
    return out.select("op_id", "set_name", F.array_join(F.col("replicas").cast("array<string>"), ",").alias("replicas"))


# -- reads


@query
def merged_read(log):
    return read.by_element(_live(log))


@query
def merged_read_relational(log):
    """The same from long relations: one aggregate."""
    return read.by_element(read.survivors(log.held, log.clock, QUORUM))


@query
def merged_read_all(log):
    return read.by_element(_live(log, (0, 1, 2)))


@query
def merge_dots_arrays(log):
    dot = F.struct("actor", "cnt")
    lists = [F.collect_list(F.when(F.col(f"{kind}{r}"), dot)).alias(f"{kind}{r}") for r in QUORUM for kind in ("held", "seen")]
    a, b = QUORUM
    each = log.wide.groupBy("set_name", "element").agg(*lists)
    live = read.merge_arrays(F.col(f"held{a}"), F.col(f"held{b}"), F.col(f"seen{a}"), F.col(f"seen{b}"))
    out = each.select("set_name", "element", live.alias("live")).where(F.size("live") > 0)
    text = F.array_join(F.transform("live", lambda d: F.concat(d["actor"], F.lit(":"), d["cnt"].cast("string"))), ",")
    return out.select("set_name", "element", F.size("live").cast("long").alias("n_dots"), text.alias("dots"))


@query
def set_value(log):
    return read.numbered(_live(log))


@query
def set_size(log):
    return log.held_of(0).groupBy("set_name").agg(F.count("*").alias("n_keys"))


@query
def set_cardinality(log):
    return _live(log).groupBy("set_name").agg(F.count_distinct("element").alias("n_elements"), F.count("*").alias("n_dots"))


@query
def element_context(log):
    """The context that a writer at replica 0 would send for an element now."""
    return read.by_element(log.held_of(0)).select("set_name", "element", F.col("dots").alias("ctx"))


@query
def concurrent_adds(log):
    return read.by_element(_live(log)).where("n_dots >= 2")


def _members(log: OpLog) -> DataFrame:
    return _spark(log).createDataFrame(MEMBERS, "set_name string, element string")


@query
def is_member(log):
    return read.membership(_live(log), _members(log))


@query
def is_subset(log):
    return read.by_element(read.subset(_live(log), _members(log)))


@query
def subset_bool(log):
    return read.contains_all(_live(log), _members(log))


def _range(log: OpLog, *bounds, **options) -> DataFrame:
    return read.by_element(read.in_range(_live(log).where(F.col("set_name") == RANGE_SET), *bounds, **options))


@query
def range_closed(log):
    return _range(log, *RANGE)


@query
def range_open(log):
    return _range(log, *RANGE, start_inclusive=False, end_inclusive=False)


@query
def range_half_open(log):
    return _range(log, *RANGE, end_inclusive=False)


@query
def range_start_only(log):
    return _range(log, RANGE[1])


@query
def range_end_only(log):
    return _range(log, None, RANGE[1])


@query
def range_first_n(log):
    return _range(log, "000010", "000500").orderBy("element").limit(10)


@query
def lowest_n(log):
    """The 20 lowest elements of each set."""
    first = Window.partitionBy("set_name").orderBy("element")
    return _live(log).select("set_name", "element").distinct().withColumn("position", F.row_number().over(first).cast("long")).where("position <= 20")


@query
def prefix_count(log):
    return _live(log).where(F.col("element").startswith("0000")).groupBy("set_name").agg(F.count_distinct("element").alias("n"))


@query
def batched_read(log):
    return read.batched(_live(log), 50)


@query
def least_last_frontier(log):
    return read.least_last(log.held, QUORUM)


@query
def not_found_sets(log):
    asked = _spark(log).createDataFrame([("click",), ("view",), ("absent",), ("missing",)], "set_name string")
    return read.not_found(asked, log.clock, 0)


def _without_click(df: DataFrame) -> DataFrame:
    """Replica 1 has never heard of the set ``click``."""
    return df.where("not (r = 1 and set_name = 'click')")


@query
def notfound_ok_read(log):
    return read.by_element(read.survivors(_without_click(log.held), _without_click(log.clock), QUORUM))


@query
def notfound_repairs(log):
    return repair.read_repairs(_without_click(log.held), _without_click(log.clock), QUORUM).where("set_name = 'click'")


# -- repairs


@query
def read_repairs(log):
    return repair.wide_repairs(log.wide, QUORUM)


@query
def read_repairs_relational(log):
    """The same from long relations."""
    return repair.read_repairs(log.held, log.clock, QUORUM)


@query
def repair_summary(log):
    return repair.wide_repairs(log.wide, QUORUM).groupBy("replica", "action").agg(F.count("*").alias("n"), F.count_distinct("set_name", "element").alias("n_elements"))


@query
def repair_apply(log):
    """What repaired replicas hold, and how much of it is in the merged read: all."""
    held = repair.wide_repaired(log.wide, QUORUM)
    live = _live(log).withColumn("live", F.lit(1))
    n_live = live.groupBy().agg(F.count("*").alias("n_live"))
    match = held.join(live, DOTS, "left").groupBy("r").agg(F.count("*").alias("n_held"), F.count("live").alias("n_common"))
    return match.crossJoin(F.broadcast(n_live)).select("r", "n_held", "n_common", "n_live")  # one row a replica, one of totals


@query
def repair_apply_relational(log):
    """The same by joins on long relations."""
    held, _ = repair.apply_repairs(log.held, log.clock, repair.read_repairs(log.held, log.clock, QUORUM))
    live = _live(log).withColumn("live", F.lit(1))
    mine = held.where(F.col("r").isin(*QUORUM))
    n_live = live.groupBy().agg(F.count("*").alias("n_live"))
    match = mine.join(live, DOTS, "left").groupBy("r").agg(F.count("*").alias("n_held"), F.count("live").alias("n_common"))
    return match.crossJoin(F.broadcast(n_live)).select("r", "n_held", "n_common", "n_live")


# -- clocks


def _packed(log: OpLog, r: int) -> DataFrame:
    return clock.compress(_clock(log, r), ["set_name"])


@query
def clock_compress(log):
    return _packed_text(clock.compress(log.clock, ["r", "set_name"]))


@query
def clock_expand(log):
    return clock.expand(_packed(log, 0))


@query
def clock_actors(log):
    return clock.actors(log.clock, ["r", "set_name"])


@query
def clock_runs(log):
    """Clocks of any size: their runs as rows."""
    return clock.runs(log.clock, ["r", "set_name"], 512)


@query
def clock_add_dots(log):
    """Replica 0's clocks with all dots that replica 1 holds."""
    return _packed_text(clock.compress(clock.add_dots(_clock(log, 0), log.held_of(1).select("set_name", "actor", "cnt")), ["set_name"]))


@query
def clock_from_vv(log):
    """Replica 0's version vectors as clocks again."""
    return _packed_text(clock.from_vv(_vv(log, 0, "vv"), ["set_name"]))


@query
def clock_point_get(log):
    """Single clocks of replica 0; a missing one is fresh."""
    return _packed_text(clock.point_get(clock.compress(_clock(log, 0), ["set_name"]), _asked_actors(log)))


@query
def tombstone_point_get(log):
    """Single tombstones of replica 0 after a handoff; a missing one is empty."""
    return _packed_text(clock.point_get(clock.compress(_handed(log).tombstone.select("set_name", "actor", "cnt"), ["set_name"]), _asked_actors(log)))


def _asked_actors(log: OpLog) -> DataFrame:
    return _spark(log).createDataFrame([("click", "r0"), ("click", "r1"), ("view", "r2"), ("click", "r9"), ("absent", "r0")], "set_name string, actor string")


@query
def clock_merge(log):
    return _packed_text(clock.compress(_where(log, F.col("seen0") | F.col("seen1")), ["set_name"]))


@query
def clock_merge_relational(log):
    """The same from two relations of dots."""
    return _packed_text(clock.compress(clock.merge(_clock(log, 0), _clock(log, 1)), ["set_name"]))


@query
def clock_intersection(log):
    return _packed_text(clock.compress(_where(log, F.col("seen0") & F.col("seen1")), ["set_name"]))


@query
def clock_intersection_relational(log):
    return _packed_text(clock.compress(clock.intersection(_clock(log, 0), _clock(log, 1)), ["set_name"]))


@query
def clock_complement(log):
    return _packed_text(clock.compress(_where(log, F.col("seen1") & ~F.col("seen0")), ["set_name"]))


@query
def clock_complement_relational(log):
    whole = clock.merge(_clock(log, 0), _clock(log, 1))
    return _packed_text(clock.compress(clock.complement(whole, _clock(log, 0)), ["set_name"]))


@query
def clock_subtract(log):
    return _packed_text(clock.compress(_where(log, F.col("seen0") & ~F.col("held0")), ["set_name"]))


@query
def clock_compare(log):
    """Replicas' clocks in pairs, and (9, 0) the merge of 0 and 1 with 0: one aggregate over the wide log."""
    seen = [F.col(f"seen{r}") for r in (0, 1, 2)]
    pairs = {(a, b): (seen[a], seen[b]) for a, b in ((0, 1), (0, 2), (1, 2))} | {(9, 0): (seen[0] | seen[1], seen[0])}
    return clock.wide_compare(log.wide, pairs)


@query
def clock_compare_relational(log):
    """Two clocks given as relations of dots."""
    return clock.compare(_clock(log, 0), _clock(log, 1), ["set_name"])


@query
def dots_seen(log):
    """Dots that replica 1 holds and replica 0 has seen, and whether 0 has seen all before them, too."""
    held = log.wide.where("held1 and seen0").select(*DOTS)
    return held.join(clock.bases(_clock(log, 0), ["set_name"]), ["set_name", "actor"], "left").select(*DOTS, clock.contiguous_seen(F.col("cnt"), F.col("base")).alias("contiguous"))


@query
def dots_seen_relational(log):
    """The same from long relations: a semi join with the clock's dots."""
    held = clock.seen(log.held_of(1), _clock(log, 0), DOT)
    return held.join(clock.bases(_clock(log, 0), ["set_name"]), ["set_name", "actor"], "left").select(*DOTS, clock.contiguous_seen(F.col("cnt"), F.col("base")).alias("contiguous"))


@query
def dots_unseen(log):
    return clock.unseen(log.held_of(1), _clock(log, 0), DOT)


@query
def contiguous_counter(log):
    out = None
    for r in (0, 1, 2):
        one = clock.contiguous_counter(clock.bases(_clock(log, r), ["set_name"]), f"r{r}").withColumn("r", F.lit(r))
        out = one if out is None else out.unionByName(one)
    return out


@query
def get_dot(log):
    sets = _spark(log).createDataFrame([("click",), ("absent",)], "set_name string")
    return clock.get_dot(clock.bases(_clock(log, 0), ["set_name"]), sets, "r0")


def _vv(log: OpLog, r: int, name: str) -> DataFrame:
    return clock.bases(_clock(log, r), ["set_name"]).groupBy("set_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("actor", "base")))).alias(name))


@query
def vv_merge(log):
    both = _vv(log, 0, "a").join(_vv(log, 1, "b"), "set_name")
    return both.select("set_name", vv.vv_text(vv.vv_merge(F.col("a"), F.col("b"))).alias("merged"))


@query
def vv_descends(log):
    both = _vv(log, 0, "a").join(_vv(log, 1, "b"), "set_name").withColumn("m", vv.vv_merge(F.col("a"), F.col("b")))
    a, b, m = F.col("a"), F.col("b"), F.col("m")
    return both.select("set_name", vv.vv_descends(a, b).alias("a_b"), vv.vv_descends(b, a).alias("b_a"), vv.vv_descends(m, a).alias("m_a"), vv.vv_dominates(m, b).alias("m_over_b"), vv.vv_text(vv.vv_increment(a, F.lit("r9"))).alias("incremented"))


@query
def vv_binary(log):
    """Version vectors of replica 0 as bytes, and what the bytes say."""
    packed = _vv(log, 0, "a").select("set_name", vv.vv_pack(F.col("a"), 2).alias("packed"))
    return packed.select("set_name", F.hex("packed").alias("packed"), vv.vv_text(vv.vv_unpack(F.col("packed"))).alias("unpacked"))


# -- contexts and keys


@query
def ctx_dictionary(log):
    return context.dictionary(_clock(log, 0), ["set_name"])


def _coded(log: OpLog) -> tuple[DataFrame, DataFrame]:
    known = context.dictionary(_clock(log, 0), ["set_name"])
    return context.encode(_live(log), known, ["set_name"], ["set_name", "element"]), known


@query
def ctx_encode(log):
    return _coded(log)[0].select("set_name", "element", F.hex("ctx").alias("ctx"))


@query
def ctx_decode(log):
    coded, known = _coded(log)
    return context.decode(coded, known, ["set_name"]).select(*DOTS)


def _keys(log: OpLog, layout: str = "nul") -> DataFrame:
    return store.keys_of(log.held_of(0), log.clock_of(0), layout)


@query
def context_terms(log):
    """Elements' contexts at replica 0 as bytes and back: the third of the forms that updates take."""
    dots = log.held_of(0).groupBy("set_name", "element").agg(F.array_sort(F.collect_list(F.struct("actor", "cnt"))).alias("d"))
    term = dots.select("set_name", "element", codec.to_term(F.col("d").alias("ctx")).alias("term"))
    back = codec.from_term(F.col("term"), "ctx array<struct<actor:string,cnt:bigint>>")["ctx"]
    text = F.array_join(F.transform(back, lambda d: F.concat(d["actor"], F.lit(":"), d["cnt"].cast("string"))), ",")
    return term.select("set_name", "element", text.alias("dots"))


@query
def clock_keys(log):
    """Which keys of a store are the clock of (click, r0)."""
    return _keys(log).groupBy(codec.is_clock_key(F.col("key"), F.lit("click"), F.lit("r0")).alias("is_clock")).agg(F.count("*").alias("n"))


@query
def dump_store(log):
    """Every key of replica 0's store, raw and decoded."""
    return store.dump(_keys(log)).select(F.hex("key").alias("key"), "kind", "set_name", "element", "actor", "cnt")


def _fold_actors(frames):
    """Elements and the sum of counters for each actor, as a caller of run_fold would write it."""
    for frame in frames:
        own = frame[frame["kind"] == "element"]
        yield own.groupby("actor", as_index=False).agg(n=("cnt", "size"), total=("cnt", "sum")).astype({"n": "int64", "total": "int64"})


@query
def run_fold(log):
    """A user function over a store's keys."""
    parts = store.run_fold(_keys(log), _fold_actors, "actor string, n long, total long")
    return parts.groupBy("actor").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


@query
def store_size(log):
    """Keys and bytes of each set in replica 0's store."""
    sized = store.dump(_keys(log))
    return store.store_size(sized, ["set_name"])


@query
def encode_keys(log):
    return _keys(log).select(F.hex("key").alias("key"))


@query
def decode_keys(log):
    return codec.decode_nul(_keys(log)).drop("key")


@query
def encode_keys_lens(log):
    return _keys(log, "lens").select(F.hex("key").alias("key"))


@query
def decode_keys_lens(log):
    return codec.decode_lens(_keys(log, "lens")).drop("key")


@query
def key_order(log):
    """Places of a set's keys in the store: clock, tombstone, elements, end; by columns, not bytes."""
    return store.dump_set(_keys(log), RANGE_SET)


# -- handoff and compaction


def _handed(log: OpLog) -> handoff.Handoff:
    return handoff.wide_hand_off(log.wide, 2, 0)


@query
def handoff_value_relational(log):
    """The same from long relations."""
    return read.by_element(handoff.hand_off(log.held, log.clock, 2, 0).visible)


@query
def handoff_clock(log):
    return _packed_text(clock.compress(_handed(log).clock, ["set_name"]))


@query
def handoff_tombstone(log):
    return _handed(log).tombstone


@query
def handoff_value(log):
    return read.by_element(_handed(log).visible)


@query
def handoff_scan(log):
    """What a sender ships: its keys, marked with who sends."""
    return log.held_of(2).withColumn("sender", F.lit("r2"))


@query
def handoff_senders(log):
    """Replica 0 after it took over from replica 1, then from replica 2."""
    return read.by_element(handoff.hand_off_many(log.held, log.clock, (1, 2), 0).visible)


@query
def handoff_stream(log):
    """What replica 0 tombstones for each of two senders, whose keys come mixed in a stream."""
    from ..streaming.handoff import run_handoffs

    return run_handoffs(log, (1, 2), 0)


@query
def compact(log):
    h = _handed(log)
    return handoff.compact(h.held, h.tombstone)[0]


@query
def compaction_gain(log):
    h = _handed(log)
    each = h.held.withColumn("k", F.lit(1)).join(h.tombstone.withColumn("t", F.lit(1)), DOTS, "left")
    return each.groupBy("set_name").agg(F.count("k").alias("n_before"), F.count(F.when(F.col("t").isNull(), 1)).alias("n_after"), F.count("t").alias("n_gone"))


@query
def tombstone_route(log):
    return handoff.route_tombstones(log.held_of(1), log.clock_of(0))


# -- statistics and streams


def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.summary(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", ["event_type"])


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", 25.0, ["event_type"])


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replica state kept by a stream over the op log: equals the batch state."""
    from ..streaming.replicas import run_stream

    log = events_log(spark, sf_dir)
    return run_stream(log)


def orders_merged_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship on a second log: orders, with priority as set and customer as element."""
    from ..sources.oplog import assign_dots as mint
    from ..sources.oplog import wide_state

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    like = orders.select(F.col("o_orderkey").alias("event_id"), F.col("o_orderpriority").alias("event_type"), F.col("o_custkey").alias("user_id"))
    ops = ops_from_events(like)
    return read.by_element(read.wide_survivors(wide_state(ops, mint(ops)), QUORUM))


def random_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic set of 1,000 elements."""
    return words.random_elements(spark, 1000, 100, 7)


def random_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many elements of the synthetic set 20 runs of neighbours of 50 elements each have, and their first places."""
    runs = words.batches_of(words.random_elements(spark, 1000, 100, 7), 20, 50, 7)
    return runs.groupBy("batch").agg(F.count("*").alias("n"), F.count_distinct("element").alias("n_distinct"))


def queries() -> dict:
    return _QUERIES | {f.__name__: f for f in (random_set, random_batches, latency_stats, latency_histogram, stream_state, orders_merged_read)}


__all__ = ["queries", "STATE"]
