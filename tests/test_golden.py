"""Golden cases of the clock algebra, merges, handoff, codecs and option checks."""

import json

import pytest
from pyspark.sql import functions as F

from dotloom.api import CausalSets, context_dots, within
from dotloom.functions import codec, context, vv
from dotloom.operators import clock, handoff, read, repair, state
from dotloom.sources import oplog, words

DOT = "actor string, cnt long"


def dots_of(vector, cloud=()):
    return [(a, n) for a, top in vector.items() for n in range(1, top + 1)] + list(cloud)


def packed(spark, dots):
    df = clock.compress(spark.createDataFrame([("s", *d) for d in dots], "set_name string, " + DOT), ["set_name"])
    return {r.actor: (r.base, list(r.cloud)) for r in df.collect()}


@pytest.mark.parametrize(
    ("vector", "cloud", "add", "expected"),
    [
        ({"a": 1}, [("a", 3), ("a", 4), ("a", 9)], ("a", 2), {"a": (4, [9])}),
        ({}, [], ("a", 1), {"a": (1, [])}),
        ({}, [], ("a", 2), {"a": (0, [2])}),
        ({"a": 1}, [("a", 4)], ("b", 2), {"a": (1, [4]), "b": (0, [2])}),
        ({"a": 4, "b": 9}, [("a", 1), ("b", 7)], ("a", 3), {"a": (4, []), "b": (9, [])}),
    ],
)
def test_adding_a_dot_compresses(spark, vector, cloud, add, expected):
    assert packed(spark, [*dots_of(vector, cloud), add]) == expected


def test_expand_undoes_compress(spark):
    dots = dots_of({"a": 3}, [("a", 7), ("b", 2)])
    df = spark.createDataFrame([("s", *d) for d in dots], "set_name string, " + DOT)
    assert sorted(map(tuple, clock.expand(clock.compress(df, ["set_name"])).collect())) == sorted(("s", *d) for d in dots)


def test_seen_and_contiguous_counter(spark):
    df = spark.createDataFrame([("s", *d) for d in dots_of({"a": 2, "b": 9, "z": 4}, [("a", 7), ("c", 99)])], "set_name string, " + DOT)
    p = clock.compress(df, ["set_name"])
    asked = spark.createDataFrame([("a", 1), ("a", 3), ("a", 7), ("c", 99), ("c", 1), ("x", 1)], DOT)
    got = asked.join(p, "actor", "left").select("actor", "cnt", clock.packed_seen(F.col("cnt"), F.col("base"), F.col("cloud")).alias("seen"))
    assert {(r.actor, r.cnt): r.seen for r in got.collect()} == {("a", 1): True, ("a", 3): False, ("a", 7): True, ("c", 99): True, ("c", 1): False, ("x", 1): False}
    assert clock.contiguous_counter(p, "z").head().base == 4
    with pytest.raises(Exception, match="no counter"):
        clock.contiguous_counter(p, "nobody").collect()


def test_merge_laws(spark):
    make = lambda dots: spark.createDataFrame(dots, DOT)
    a, b, c = make([("a", 1), ("b", 4)]), make([("b", 1), ("b", 2)]), make([("c", 3)])
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(clock.merge(a, a)) == rows(a)
    assert rows(clock.merge(a, b)) == rows(clock.merge(b, a))
    assert rows(clock.merge(clock.merge(a, b), c)) == rows(clock.merge(a, clock.merge(b, c)))


def test_compare(spark):
    make = lambda dots: spark.createDataFrame([("s", *d) for d in dots], "set_name string, " + DOT)
    one, two, other = make([("a", 1)]), make([("a", 1), ("b", 1)]), make([("c", 1)])
    said = lambda x, y: clock.compare(x, y, ["set_name"]).head().relation
    assert [said(one, one), said(two, one), said(one, two), said(one, other)] == ["equal", "dominates", "dominated", "concurrent"]


def test_increment_and_get_dot(spark):
    ops = spark.createDataFrame([(1, "s", "x", 0, "add_blind"), (2, "s", "y", 1, "add_blind"), (3, "s", "z", 0, "remove"), (4, "s", "z", 0, "add_ctx")], "op_id long, set_name string, element string, replica int, op string")
    for span in (1, 2, 1 << 20):
        got = {(r.op_id, r.actor, r.cnt) for r in oplog.assign_dots(ops, span=span).collect()}
        assert got == {(1, "r0", 1), (2, "r1", 1), (4, "r0", 2)}
    base = spark.createDataFrame([("s", "r0", 5)], "set_name string, actor string, base long")
    assert {(r.op_id, r.cnt) for r in oplog.assign_dots(ops, base).collect()} == {(1, 6), (2, 1), (4, 7)}


def test_vector_functions(spark):
    df = spark.sql("SELECT map('a', 2L, 'b', 1L) AS a, map('a', 1L, 'c', 3L) AS b, map('a', 1L) AS low")
    r = df.select(
        vv.vv_text(vv.vv_merge(F.col("a"), F.col("b"))).alias("m"),
        vv.vv_descends(F.col("a"), F.col("low")).alias("up"),
        vv.vv_descends(F.col("a"), F.col("b")).alias("side"),
        vv.vv_dominates(F.col("a"), F.col("a")).alias("same"),
        vv.vv_text(vv.vv_increment(F.col("a"), F.lit("b"))).alias("inc"),
    ).head()
    assert tuple(r) == ("a:2,b:1,c:3", True, False, False, "a:2,b:2")


STATE = "r int, set_name string, element string, actor string, cnt long"


def test_merge_drops_what_one_replica_removed(spark):
    held = spark.createDataFrame([(0, "s", "x", "a", 1), (1, "s", "x", "a", 1), (0, "s", "y", "a", 2), (1, "s", "z", "b", 1)], STATE)
    seen = spark.createDataFrame([(0, "s", "x", "a", 1), (1, "s", "x", "a", 1), (0, "s", "y", "a", 2), (1, "s", "y", "a", 2), (1, "s", "z", "b", 1)], STATE)
    assert {r.element for r in read.survivors(held, seen, (0, 1)).collect()} == {"x", "z"}
    got = {(r.replica, r.element, r.action) for r in repair.read_repairs(held, seen, (0, 1)).collect()}
    assert got == {(0, "y", "remove"), (0, "z", "add")}
    fixed, clocks = repair.apply_repairs(held, seen, repair.read_repairs(held, seen, (0, 1)))
    assert {r.element for r in fixed.where("r = 0").collect()} == {r.element for r in fixed.where("r = 1").collect()} == {"x", "z"}
    h = handoff.hand_off(held, seen, 1, 0)
    assert {r.element for r in h.visible.collect()} == {"x", "z"}
    assert {r.element for r in h.tombstone.collect()} == {"y"}
    kept, empty = handoff.compact(h.held, h.tombstone)
    assert {r.element for r in kept.collect()} == {"x", "z"} and empty.isEmpty()


def test_routes(spark):
    dots = spark.createDataFrame([("s", "x", "a", 1), ("s", "x", "a", 2)], "set_name string, element string, actor string, cnt long")
    assert {(r.cnt, r.target) for r in handoff.route_tombstones(dots, dots.where("cnt = 1")).collect()} == {(1, "tombstone"), (2, "clock")}


def test_context_codec(spark):
    dots = spark.createDataFrame([("s", "e", "a", 1), ("s", "e", "c", 300), ("s", "e", "d", 70000), ("s", "f", "a", 0)], "set_name string, element string, actor string, cnt long")
    known = context.dictionary(dots.select("set_name", "actor"), ["set_name"])
    assert {(r.actor, r.id) for r in known.collect()} == {("a", 1), ("c", 2), ("d", 3)}
    coded = context.encode(dots, known, ["set_name"], ["set_name", "element"])
    back = context.decode(coded, known, ["set_name"]).select("set_name", "element", "actor", "cnt")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, dots.collect()))
    grown = context.grow(known, spark.createDataFrame([("s", "b"), ("s", "a"), ("t", "q")], "set_name string, actor string"), ["set_name"])
    assert {(r.set_name, r.actor, r.id) for r in grown.collect()} >= {("s", "b", 4), ("t", "q", 1)}


def test_key_round_trips(spark):
    df = spark.createDataFrame([("s", "e1", "a", 5), ("ünï", "x\0y", "actor-2", 2**40), ("", "", "", 0)], "set_name string, element string, actor string, cnt long")
    c = [F.col(x) for x in ("set_name", "element", "actor", "cnt")]
    for make, undo in ((codec.nul_key, codec.decode_nul), (codec.lens_key, codec.decode_lens)):
        got = undo(df.select(make("element", *c).alias("key")))
        assert sorted(map(tuple, got.select("kind", "set_name", "element", "actor", "cnt").collect())) == sorted(("element", *r) for r in map(tuple, df.collect()))
        for kind, actor in (("clock", "a"), ("tombstone", "a"), ("end", None)):
            key = df.limit(1).select(make(kind, F.lit("s"), actor=None if actor is None else F.lit(actor)).alias("key"))
            assert tuple(undo(key).drop("key").head()) == (kind, "s", None, actor, None)
    one = df.where("set_name = 's'").select(F.hex(codec.nul_key("element", *c)).alias("k")).head().k
    assert one == "0101" + "73" + "00" + "65" + "00" + "6531" + "00" + "61" + "00" + "0000000000000005" + "00" + "0" * 15 + "1" + "0" * 15 + "2" + "0" * 15 + "1"


def test_range_options():
    read.check_range(None, "a")
    read.check_range("a", "z")
    read.check_range("a")
    for bad in (("z", "a"), (1, None), (None, 2)):
        with pytest.raises(ValueError):
            read.check_range(*bad)
    with pytest.raises(ValueError):
        read.check_range("a", "z", start_inclusive="yes")
    for quorum in ((), (0, 0)):
        with pytest.raises(ValueError):
            read.check_quorum(quorum)


def test_write_acks_and_routing(spark):
    ops = spark.createDataFrame([(1,), (2,), (3,)], "op_id long")
    got = state.write_acks(ops, spark.createDataFrame([(1, 0), (1, 0), (2, 0), (2, 1)], "op_id long, r int"))
    assert {tuple(r) for r in got.collect()} == {(1, 1, False), (2, 2, True), (3, 0, False)}
    ring = state.preflist(spark.createDataFrame([("s",)], "set_name string"), state.ring_position(F.col("set_name")), 8).head().replicas
    assert len(set(ring)) == 3 and all(0 <= x < 8 for x in ring)


def test_client(spark):
    sets = CausalSets.empty(spark).update("s", ["b", "a"]).update("s", ["a"], replica=1)
    rows = {r.element: r.n_dots for r in sets.read("s").collect()}
    assert rows == {"a": 2, "b": 1}  # a blind add is concurrent with all others
    seen = [("r0", 2), ("r1", 1)]
    gone = sets.update("s", removes=["a", "b"], ctx={"a": seen})
    assert [r.element for r in gone.read("s").collect()] == ["b"]  # a removal without a context does nothing
    again = sets.update("s", ["a"], ctx={"a": seen})
    assert {r.element: r.dots for r in again.read("s").collect()} == {"a": "r0:3", "b": "r0:1"}
    assert [[r.element for r in batch] for batch in sets.stream_read("s", 1)] == [["a"], ["b"]]
    assert sets.is_member("s", "a").head().is_member and not sets.is_member("s", "q").head().is_member
    assert sets.has_all("s", ["a", "b"]).head().is_subset and not sets.has_all("s", ["a", "q"]).head().is_subset
    assert [r.element for r in sets.is_subset("s", ["a", "q"]).collect()] == ["a"]
    assert sets.read("nowhere").isEmpty() and sets.repairs().isEmpty()
    assert [r.element for r in sets.read("s", range_start="b").collect()] == ["b"]
    assert {(r.actor, r.base) for r in sets.clock(0).collect()} == {("r0", 2), ("r1", 1)}
    with pytest.raises(ValueError):
        sets.read("s", colour="red")
    with pytest.raises(ValueError):
        sets.update("s", ["x"], delivered=(0,))


def test_forms_of_contexts(spark):
    dots = [("r0", 2), ("r1", 300)]
    assert context_dots(None) == context_dots(b"") == []
    assert context_dots(dots) == context_dots(json.dumps(dots).encode()) == dots
    df = spark.createDataFrame([("s", "e", *d) for d in dots], "set_name string, element string, " + DOT)
    known = spark.createDataFrame([("s", "r0", 1), ("s", "r1", 2)], "set_name string, actor string, id int")
    coded = bytes(context.encode(df, known, ["set_name"], ["set_name", "element"]).head().ctx)
    assert context_dots(coded, {1: "r0", 2: "r1"}) == dots
    sets = CausalSets.empty(spark).update("s", ["a"]).update("s", [("a", json.dumps([("r0", 1)]).encode()), "b"])
    assert {r.element: r.dots for r in sets.read("s").collect()} == {"a": "r0:2", "b": "r0:3"}


def test_kept_logs_and_client_options(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    CausalSets.open(spark, path).update("s", ["a", "b"])
    sets = CausalSets.open(spark, path).update("s", removes=["a"], ctx={"a": [("r0", 1)]}, replica=1)
    assert [(r.element, r.dots) for r in CausalSets.open(spark, path).fetch("s", timeout=60_000)] == [("b", "r0:2")]
    copy = sets.save(f"file://{tmp_path}/copy").update("s", ["c"])
    assert [r.element for r in copy.fetch("s", recv_timeout="infinity")] == ["b", "c"]
    assert [r.element for r in copy.fetch("s", ctx=[("r0", 2)])] == ["c"]
    assert len(sets.fetch("s")) == 1
    copy.write_read("s", lambda df: df.write.parquet(f"{tmp_path}/out"))
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert set(sets.bm_read("s", 2)) == {"max", "min", "avg"}
    for bad in (0, -1, True, "soon"):
        with pytest.raises(ValueError):
            sets.read("s", timeout=bad)
    with pytest.raises(TimeoutError):
        within(spark, 0.05, lambda: spark.range(1 << 36).selectExpr("sum(id % 7)").collect())
    assert {r.kind for r in copy.dump_set(0, "s").collect()} == {"clock", "tombstone", "element", "end"}
    dropped = copy.drop_replica(1)
    assert dropped.log.clock_of(1).isEmpty() and not dropped.log.clock_of(0).isEmpty()


def test_incarnations():
    one = oplog.next_incarnation({}, "n", 100)
    assert one == {"actor": "n.100", "last_epoch": 100}
    gone = oplog.cleared_incarnation(one)
    assert oplog.next_incarnation(gone, "n", 50) == {"actor": "n.101", "last_epoch": 101}


def test_runs_join_across_spans(spark):
    cnts = [1, 2, 3, 4, 5, 6, 7, 8, 9, 12, 15, 16, 17, 40]
    df = spark.createDataFrame([("s", "a", n) for n in cnts] + [("s", "b", 4), ("s", "b", 3)], "set_name string, " + DOT)
    for span in (2, 4, 1 << 16):
        got = sorted((r.actor, r.low, r.high) for r in clock.runs(df, ["set_name"], span).collect())
        assert got == [("a", 1, 9), ("a", 12, 12), ("a", 15, 17), ("a", 40, 40), ("b", 3, 4)]
        assert {r.actor: r.base for r in clock.bases(df, ["set_name"], span).collect()} == {"a": 9, "b": 0}


def test_positions_in_many_parts(spark):
    df = spark.createDataFrame([(f"s{i % 2}", f"{(i * 7919) % 6007:05d}") for i in range(6007)], "set_name string, element string")
    got = read.numbered(df, part_rows=20).collect()
    for name in ("s0", "s1"):
        mine = sorted((r.position, r.element) for r in got if r.set_name == name)
        assert [p for p, _ in mine] == list(range(1, len(mine) + 1)) and [e for _, e in mine] == sorted(e for _, e in mine)


def test_word_sources(spark, tmp_path):
    (tmp_path / "words.txt").write_bytes(b"one\r\ntwo\nthree\n")
    assert sorted(r.element for r in words.read_words(spark, str(tmp_path / "words.txt")).collect()) == ["one", "three", "two"]
    some = words.random_elements(spark, 20, 100, 3)
    assert {len(r.element) for r in some.collect()} == {100}
    assert words.batches_of(some, 3, 5).groupBy("batch").count().where("count = 5").count() == 3
    assert words.add_ops(some, "s").count() == 20
