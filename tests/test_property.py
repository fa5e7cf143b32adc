"""Random histories: the closed forms against a sequential replica."""

import random

from dotloom.operators import handoff, read
from dotloom.sources.oplog import OpLog, deliveries, ops_from_events, wide_state, assign_dots
from dotloom.streaming.replicas import step

OPS = "op_id long, set_name string, element string, replica int, op string"
DOTS = "op_id long, set_name string, element string, actor string, cnt long"


def history(seed):
    """Operations with contexts as their writers saw them, and deltas that reach replicas late, twice or never."""
    rng = random.Random(seed)
    seen, held = ({r: set() for r in range(3)} for _ in range(2))
    of, counters = {}, [0, 0, 0]
    ops, adds, ctx, delivery, late = [], [], [], [], []
    for op in range(60):
        r, e = rng.randrange(3), rng.choice("abcd")
        kind = rng.choice(["add_blind", "add_ctx", "remove"])
        observed = [] if kind == "add_blind" else [d for d in held[r] if of[d] == e]
        dot = None
        if kind != "remove":
            counters[r] += 1
            dot = (f"r{r}", counters[r])
            of[dot] = e
            adds.append((op, "s", e, *dot))
        ops.append((op, "s", e, r, kind))
        ctx += [(op, "s", e, *d) for d in observed]
        delta = (dot[0] if dot else None, dot[1] if dot else None, observed)
        step(seen[r], held[r], [delta])
        delivery.append((op, r))
        for other in {0, 1, 2} - {r}:
            if rng.random() < 0.6:
                late += [(other, op, delta)] * rng.choice([1, 1, 2])
                delivery.append((op, other))
        if rng.random() < 0.3:
            rng.shuffle(late)
            for where, _, d in late:
                step(seen[where], held[where], [d])
            late = []
    for where, _, d in late:
        step(seen[where], held[where], [d])
    return ops, adds, ctx, delivery, seen, held


def test_closed_forms_equal_sequential_replicas(spark):
    for seed in range(3):
        ops, adds, ctx, delivery, seen, held = history(seed)
        log = OpLog(spark.createDataFrame(ops, OPS), spark.createDataFrame(adds, DOTS), spark.createDataFrame(delivery, "op_id long, r int"), spark.createDataFrame(ctx, DOTS))
        for relation, truth in ((log.held, held), (log.clock, seen)):
            got = {r: set() for r in range(3)}
            for row in relation.collect():
                got[row.r].add((row.actor, row.cnt))
            assert got == truth
        live = {(x.actor, x.cnt) for x in read.survivors(log.held, log.clock, (0, 1)).collect()}
        assert live == {d for d in held[0] | held[1] if all(d in held[r] or d not in seen[r] for r in (0, 1))}
        handed = handoff.hand_off(log.held, log.clock, 1, 0)
        assert {(x.actor, x.cnt) for x in handed.visible.collect()} == live


def test_wide_state_equals_relations(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ops = ops_from_events(events)
    adds = assign_dots(ops)
    plain = OpLog.from_relations(ops, deliveries(ops), adds)
    wide = OpLog(ops, adds, plain.delivery, plain.ctx, wide_state(ops, adds))
    for name in ("held", "clock", "removed", "delivered_adds"):
        a, b = getattr(plain, name), getattr(wide, name)
        assert sorted(map(tuple, a.select(b.columns).collect())) == sorted(map(tuple, b.collect())), name
    assert sorted(map(tuple, read.wide_survivors(wide.wide, (0, 1)).collect())) == sorted(map(tuple, read.survivors(plain.held, plain.clock, (0, 1)).collect()))


def test_empty_log(spark):
    log = OpLog(spark.createDataFrame([], OPS), spark.createDataFrame([], DOTS), spark.createDataFrame([], "op_id long, r int"), spark.createDataFrame([], DOTS))
    assert log.held.isEmpty() and log.clock.isEmpty()
    assert read.survivors(log.held, log.clock, (0, 1)).isEmpty()
    assert handoff.hand_off(log.held, log.clock, 0, 1).visible.isEmpty()


def receive(sender, receiver):
    """A handoff key by key, as a receiver lives it: (clock, held, tombstone) of both are sets of dots."""
    (clock_s, held_s, tomb_s), (clock_r, held_r, tomb_r) = sender, receiver
    tracker, seen, held = set(), set(clock_r), set(held_r)
    for dot in sorted(held_s - tomb_s):
        tracker.add(dot)
        if dot not in seen:
            seen.add(dot)
            held.add(dot)
    removed = clock_s - tracker
    return seen | clock_s, held, tomb_r | (removed & clock_r)


def compacted(state):
    clock, held, tomb = state
    return clock, held - tomb, set()


def frames(spark, states):
    """(held, clock, tombstone) relations of all replicas."""
    rows = lambda k: [(r, "s", d[2], d[0], d[1]) for r, s in enumerate(states) for d in sorted(s[k])]
    return [spark.createDataFrame(rows(k), "r int, set_name string, element string, actor string, cnt long") for k in (1, 0, 2)]


def dots(df):
    return {(r.actor, r.cnt, r.element) for r in df.collect()}


def test_interleaved_handoffs_and_compactions(spark):
    """Adds, removes, lost and repeated deltas, handoffs and compactions in any order; relations follow the replicas."""
    for seed in range(4):
        rng = random.Random(seed)
        states = [(set(), set(), set()) for _ in range(3)]
        counters, deltas = [0, 0, 0], []
        for _ in range(40):
            r = rng.randrange(3)
            clock, held, tomb = states[r]
            what = rng.choice(["add", "add", "remove", "replicate", "replicate", "handoff", "compact"])
            if what in ("add", "remove"):
                element = rng.choice("abc")
                ctx = {d for d in held - tomb if d[2] == element} if what == "remove" or rng.random() < 0.5 else set()
                dot = None
                if what == "add":
                    counters[r] += 1
                    dot = (f"r{r}", counters[r], element)
                deltas.append((dot, ctx))
                applied = [deltas[-1]]
            else:
                applied = rng.sample(deltas, min(len(deltas), 3)) if what == "replicate" else []
            for dot, ctx in applied:  # what is removed and was seen goes to the tombstone, or the clock
                tomb = tomb | (ctx & clock)
                clock = clock | ctx
                if dot and dot not in clock:
                    clock, held = clock | {dot}, held | {dot}
            states[r] = (clock, held, tomb)
            if what == "compact":
                states[r] = compacted(states[r])
            if what == "handoff":
                states[r] = receive(states[rng.choice([x for x in range(3) if x != r])], states[r])
        held, clock, tomb = frames(spark, states)
        for sender, receiver in ((0, 1), (2, 1)):
            got = handoff.hand_off(held, clock, sender, receiver, tomb)
            want = receive(states[sender], states[receiver])
            assert (dots(got.clock), dots(got.held), dots(got.tombstone)) == want
            smaller = handoff.compact(got.held, got.tombstone)[0]
            assert dots(smaller) == dots(got.visible) == compacted(want)[1]
            # The receiver then reads what a merged read of both would have given.
            visible = [s[1] - s[2] for s in (states[sender], states[receiver])]
            merged = {d for d in visible[0] | visible[1] if all(d in v or d not in s[0] for v, s in zip(visible, (states[sender], states[receiver]), strict=True))}
            assert dots(got.visible) == merged
        plain = [(s[0], s[1] - s[2], set()) for s in states]
        held, clock, _ = frames(spark, plain)
        many = handoff.hand_off_many(held, clock, (0, 2), 1)
        want = receive(plain[2], receive(plain[0], plain[1]))
        assert (dots(many.clock), dots(many.held), dots(many.tombstone)) == want


def test_runs_of_a_tracker():
    rng = random.Random(4)
    from dotloom.streaming import handoff as tracker

    for _ in range(200):
        a, b = ({rng.randrange(1, 40) for _ in range(rng.randrange(30))} for _ in range(2))
        runs = [[], []]
        for k, s in enumerate((a, b)):
            for x in rng.sample(sorted(s), len(s)):
                runs[k] = tracker.with_run(runs[k], x, x)
        assert tracker.counters(runs[0]) == len(a)
        assert all(x[1] + 1 < y[0] for x, y in zip(runs[0], runs[0][1:], strict=False))
        left = tracker.without_runs(*runs)
        assert {n for low, high in left for n in range(low, high + 1)} == a - b
