"""Plain SQL for each registered query, for another engine to check the results with.

It follows the definitions (joins of contexts with deliveries), not the plans of this package.
"""

from __future__ import annotations

from .catalogue import MEMBERS, RANGE, RANGE_SET, RESTARTS

LOG = """
ops AS (
  SELECT event_id AS op_id, event_type AS set_name, lpad(CAST(user_id AS VARCHAR), 6, '0') AS element,
         CAST(event_id % 3 AS INTEGER) AS replica,
         CASE event_id % 4 WHEN 0 THEN 'add_blind' WHEN 3 THEN 'remove' ELSE 'add_ctx' END AS op
  FROM events
), reps AS (SELECT unnest([0, 1, 2]) AS r),
adds AS (
  SELECT op_id, set_name, element, replica, 'r' || replica AS actor,
         row_number() OVER (PARTITION BY set_name, replica ORDER BY op_id) AS cnt
  FROM ops WHERE op <> 'remove'
), delivery AS (SELECT op_id, r FROM ops, reps WHERE r = replica OR (op_id + 2 * r) % 5 < 2),
ctx AS (
  SELECT o.op_id, o.set_name, o.element, a.actor, a.cnt
  FROM ops o
  JOIN adds a ON a.set_name = o.set_name AND a.element = o.element AND a.op_id < o.op_id
  JOIN delivery d ON d.op_id = a.op_id AND d.r = o.replica
  WHERE o.op <> 'add_blind'
), dadds AS (SELECT r, set_name, element, actor, cnt FROM adds JOIN delivery USING (op_id)),
removed AS (SELECT DISTINCT r, set_name, element, actor, cnt FROM ctx JOIN delivery USING (op_id)),
clock AS (SELECT * FROM dadds UNION SELECT * FROM removed),
held AS (
  SELECT * FROM dadds h
  WHERE NOT EXISTS (SELECT 1 FROM removed x WHERE x.r = h.r AND x.set_name = h.set_name AND x.actor = h.actor AND x.cnt = h.cnt)
)"""


def _live(name: str, quorum: str, held: str = "held", clock: str = "clock") -> str:
    return f"""{name} AS (
  SELECT set_name, element, actor, cnt FROM {clock} LEFT JOIN (SELECT *, 1 AS h FROM {held}) x USING (r, set_name, element, actor, cnt)
  WHERE r IN ({quorum}) GROUP BY set_name, element, actor, cnt HAVING count(h) > 0 AND count(h) = count(*)
)"""


LIVE = _live("live", "0, 1")
BY_ELEMENT = "SELECT set_name, element, count(*) AS n_dots, string_agg(actor || ':' || cnt, ',' ORDER BY actor, cnt) AS dots FROM {} GROUP BY set_name, element"


def _with(body: str, *ctes: str) -> str:
    return "WITH " + ", ".join([LOG.strip(), *ctes]) + "\n" + body


def _packed(source: str, keys: str = "set_name") -> str:
    return f"""SELECT {keys}, actor, CAST(coalesce(max(cnt) FILTER (cnt = k), 0) AS BIGINT) AS base,
       coalesce(string_agg(CAST(cnt AS VARCHAR), ',' ORDER BY cnt) FILTER (cnt <> k), '') AS cloud,
       count(*) FILTER (cnt <> k) AS n_gapped
FROM (SELECT *, row_number() OVER (PARTITION BY {keys}, actor ORDER BY cnt) AS k FROM (SELECT DISTINCT {keys}, actor, cnt FROM {source}))
GROUP BY {keys}, actor"""


def _range(where: str, tail: str = "") -> str:
    return _with(f"{BY_ELEMENT.format(f'''(SELECT * FROM live WHERE set_name = '{RANGE_SET}' AND {where})''')} {tail}", LIVE)


MEMBER_ROWS = "asked AS (SELECT DISTINCT * FROM (VALUES " + ", ".join(f"('{s}', '{e}')" for s, e in MEMBERS) + ") t(set_name, element))"
C0, C1 = "c0 AS (SELECT set_name, actor, cnt FROM clock WHERE r = 0)", "c1 AS (SELECT set_name, actor, cnt FROM clock WHERE r = 1)"
BASES = "pk AS (" + _packed("clock", "r, set_name") + ")"
HANDOFF = """
cs AS (SELECT set_name, element, actor, cnt FROM clock WHERE r = 2), cr AS (SELECT set_name, element, actor, cnt FROM clock WHERE r = 0),
ks AS (SELECT set_name, element, actor, cnt FROM held WHERE r = 2), kr AS (SELECT set_name, element, actor, cnt FROM held WHERE r = 0),
hclock AS (SELECT * FROM cs UNION SELECT * FROM cr),
hheld AS (SELECT * FROM kr UNION (SELECT * FROM ks EXCEPT SELECT * FROM cr)),
htomb AS ((SELECT * FROM cs EXCEPT SELECT * FROM ks) INTERSECT SELECT * FROM cr),
hvis AS (SELECT * FROM hheld EXCEPT SELECT * FROM htomb)""".strip()
SENDERS = """
s1 AS (SELECT set_name, element, actor, cnt FROM clock WHERE r = 1), k1 AS (SELECT set_name, element, actor, cnt FROM held WHERE r = 1),
s2 AS (SELECT set_name, element, actor, cnt FROM clock WHERE r = 2), k2 AS (SELECT set_name, element, actor, cnt FROM held WHERE r = 2),
s0 AS (SELECT set_name, element, actor, cnt FROM clock WHERE r = 0), k0 AS (SELECT set_name, element, actor, cnt FROM held WHERE r = 0),
t1 AS ((SELECT * FROM s1 EXCEPT SELECT * FROM k1) INTERSECT SELECT * FROM s0),
h1 AS (SELECT * FROM k0 UNION (SELECT * FROM k1 EXCEPT SELECT * FROM s0)),
q1 AS (SELECT * FROM s1 UNION SELECT * FROM s0),
t2 AS (SELECT * FROM t1 UNION ((SELECT * FROM s2 EXCEPT SELECT * FROM k2) INTERSECT SELECT * FROM q1)),
h2 AS (SELECT * FROM h1 UNION (SELECT * FROM k2 EXCEPT SELECT * FROM q1)),
hvis AS (SELECT * FROM h2 EXCEPT SELECT * FROM t2)""".strip()
REPAIRS = """
rep AS (
  SELECT q.r AS replica, set_name, element, 'add' AS action, actor, cnt FROM {live} l, (SELECT unnest([0, 1]) AS r) q
  WHERE NOT EXISTS (SELECT 1 FROM {held} h WHERE h.r = q.r AND h.set_name = l.set_name AND h.element = l.element AND h.actor = l.actor AND h.cnt = l.cnt)
  UNION ALL
  SELECT h.r, set_name, element, 'remove', actor, cnt FROM {held} h
  WHERE r IN (0, 1) AND NOT EXISTS (SELECT 1 FROM {live} l WHERE h.set_name = l.set_name AND h.element = l.element AND h.actor = l.actor AND h.cnt = l.cnt)
)""".strip()
REP = REPAIRS.format(live="live", held="held")
MISSING = ["held1 AS (SELECT * FROM held WHERE NOT (r = 1 AND set_name = 'click'))", "clock1 AS (SELECT * FROM clock WHERE NOT (r = 1 AND set_name = 'click'))", _live("live1", "0, 1", "held1", "clock1")]


def _be(n: str, digits: int) -> str:
    return f"lpad(printf('%X', CAST({n} AS BIGINT)), {digits}, '0')"


def _le(n: str, digits: int) -> str:
    h = _be(n, digits)
    return " || ".join(f"substr({h}, {i}, 2)" for i in range(digits - 1, 0, -2))


def _nul(kind: str, element: str = "''", actor: str = "''", cnt: str | None = None) -> str:
    counter = f" || {_be(cnt, 16)} || '00'" if cnt else " || '00'"
    lengths = " || ".join(_be(f"strlen({x})", 16) for x in ("set_name", element, actor))
    return f"'0101' || hex(set_name) || '00' || '{kind}' || '00' || hex({element}) || '00' || hex({actor}) || '00'{counter} || {lengths}"


def _lens(kind: str, element: str | None = None, actor: str = "''", cnt: str | None = None) -> str:
    head = f"{_le('strlen(set_name)', 8)} || hex(set_name) || '{kind}'"
    if cnt:
        return f"{head} || {_le(f'strlen({element})', 8)} || hex({element}) || {_le(f'strlen({actor})', 8)} || hex({actor}) || {_le(cnt, 16)}"
    return f"{head} || hex({actor})"


def _all_keys(make) -> str:
    meta = "(SELECT DISTINCT set_name, actor FROM clock WHERE r = 0)"
    return f"""SELECT {make('65', 'element', 'actor', 'cnt')} AS key FROM held WHERE r = 0
UNION ALL SELECT {make('63', actor='actor')} FROM {meta} UNION ALL SELECT {make('64', actor='actor')} FROM {meta}
UNION ALL SELECT DISTINCT {make('7A')} FROM {meta}"""


KEY_ROWS = """SELECT 'element' AS kind, set_name, element, actor, cnt FROM held WHERE r = 0
UNION ALL SELECT DISTINCT 'clock', set_name, NULL, actor, NULL FROM clock WHERE r = 0
UNION ALL SELECT DISTINCT 'tombstone', set_name, NULL, actor, NULL FROM clock WHERE r = 0
UNION ALL SELECT DISTINCT 'end', set_name, NULL, NULL, NULL FROM clock WHERE r = 0"""


def _compare(a: str, b: str, x: int, y: int) -> str:
    return f"""SELECT set_name, {x} AS a, {y} AS b, only_a, only_b,
  CASE WHEN only_a > 0 AND only_b > 0 THEN 'concurrent' WHEN only_a > 0 THEN 'dominates' WHEN only_b > 0 THEN 'dominated' ELSE 'equal' END AS relation
FROM (SELECT set_name, count(*) FILTER (q IS NULL) AS only_a, count(*) FILTER (p IS NULL) AS only_b
      FROM (SELECT DISTINCT set_name, actor, cnt, 1 AS p FROM {a}) FULL JOIN (SELECT DISTINCT set_name, actor, cnt, 1 AS q FROM {b}) USING (set_name, actor, cnt) GROUP BY set_name)"""


def _ctx_hex() -> str:
    h = "printf('%X', cnt)"
    even = f"CASE WHEN length({h}) % 2 = 1 THEN '0' || {h} ELSE {h} END"
    return f"{_be(f'4 + length({even}) / 2', 8)} || {_be('id', 8)} || {even}"


DICT = "dict AS (SELECT set_name, actor, CAST(dense_rank() OVER (PARTITION BY set_name ORDER BY actor) AS INTEGER) AS id FROM (SELECT DISTINCT set_name, actor FROM clock WHERE r = 0))"
VV = BASES + ", a AS (SELECT set_name, actor, base FROM pk WHERE r = 0), b AS (SELECT set_name, actor, base FROM pk WHERE r = 1), m AS (SELECT set_name, actor, greatest(coalesce(a.base, 0), coalesce(b.base, 0)) AS base FROM a FULL JOIN b USING (set_name, actor))"


def _descends(x: str, y: str, strict: bool = False) -> str:
    sub = lambda p, q: f"NOT EXISTS (SELECT 1 FROM {q} q LEFT JOIN {p} p USING (set_name, actor) WHERE q.set_name = s.set_name AND (p.base IS NULL OR p.base < q.base))"
    return sub(x, y) + (f" AND NOT ({sub(y, x)})" if strict else "")


def oracle_sql() -> dict[str, str]:
    out = {
        "assign_dots": _with("SELECT op_id, set_name, element, actor, cnt FROM adds"),
        "observed_ctx": _with("SELECT op_id, count(*) AS n_dots, string_agg(actor || ':' || cnt, ',' ORDER BY actor, cnt) AS dots FROM ctx GROUP BY op_id"),
        "replica_state": _with(
            "SELECT set_name, "
            + ", ".join(f"count(*) FILTER (r = {r} AND k = '{k}') AS {k}{r}" for r in (0, 1, 2) for k in ("seen", "held"))
            + " FROM (SELECT r, set_name, 'seen' AS k FROM clock UNION ALL SELECT r, set_name, 'held' FROM held) GROUP BY set_name"
        ),
        "local_set_read": _with(BY_ELEMENT.format("(SELECT * FROM held WHERE r = 0)")),
        "delta_join_idempotent": _with(
            "SELECT h.r, n AS held_once, n AS held_twice, m AS clock_once, m AS clock_twice FROM (SELECT r, count(*) AS n FROM held GROUP BY r) h JOIN (SELECT r, count(*) AS m FROM clock GROUP BY r) c USING (r)"
        ),
        "state_merge": _with(
            "SELECT set_name, n_keys, n_clock FROM (SELECT set_name, count(DISTINCT (actor, cnt)) AS n_keys FROM held GROUP BY 1) JOIN (SELECT set_name, count(DISTINCT (actor, cnt)) AS n_clock FROM clock GROUP BY 1) USING (set_name)"
        ),
        "write_quorum": _with("SELECT op_id, count(*) AS n_acks, count(*) >= 2 AS ok FROM delivery GROUP BY op_id"),
        "preflist_routing": _with("SELECT op_id, set_name, (op_id % 64) || ',' || ((op_id + 1) % 64) || ',' || ((op_id + 2) % 64) AS replicas FROM ops"),
        "merged_read": _with(BY_ELEMENT.format("live"), LIVE),
        "merged_read_all": _with(BY_ELEMENT.format("live"), _live("live", "0, 1, 2")),
        "set_value": _with("SELECT set_name, element, row_number() OVER (PARTITION BY set_name ORDER BY element) AS position FROM (SELECT DISTINCT set_name, element FROM live)", LIVE),
        "set_size": _with("SELECT set_name, count(*) AS n_keys FROM held WHERE r = 0 GROUP BY set_name"),
        "set_cardinality": _with("SELECT set_name, count(DISTINCT element) AS n_elements, count(*) AS n_dots FROM live GROUP BY set_name", LIVE),
        "element_context": _with("SELECT set_name, element, string_agg(actor || ':' || cnt, ',' ORDER BY actor, cnt) AS ctx FROM held WHERE r = 0 GROUP BY ALL"),
        "concurrent_adds": _with(f"SELECT * FROM ({BY_ELEMENT.format('live')}) WHERE n_dots >= 2", LIVE),
        "is_member": _with(
            f"SELECT set_name, element, n_dots IS NOT NULL AS is_member, coalesce(n_dots, 0) AS n_dots, coalesce(dots, '') AS dots FROM asked LEFT JOIN ({BY_ELEMENT.format('live')}) USING (set_name, element)", LIVE, MEMBER_ROWS
        ),
        "is_subset": _with(BY_ELEMENT.format("live SEMI JOIN asked USING (set_name, element)"), LIVE, MEMBER_ROWS),
        "subset_bool": _with("SELECT set_name, bool_and(EXISTS (SELECT 1 FROM live l WHERE l.set_name = a.set_name AND l.element = a.element)) AS is_subset FROM asked a GROUP BY set_name", LIVE, MEMBER_ROWS),
        "range_closed": _range(f"element BETWEEN '{RANGE[0]}' AND '{RANGE[1]}'"),
        "range_open": _range(f"element > '{RANGE[0]}' AND element < '{RANGE[1]}'"),
        "range_half_open": _range(f"element >= '{RANGE[0]}' AND element < '{RANGE[1]}'"),
        "range_start_only": _range(f"element >= '{RANGE[1]}'"),
        "range_end_only": _range(f"element <= '{RANGE[1]}'"),
        "range_first_n": _range("element BETWEEN '000010' AND '000500'", "ORDER BY element LIMIT 10"),
        "lowest_n": _with("SELECT * FROM (SELECT set_name, element, row_number() OVER (PARTITION BY set_name ORDER BY element) AS position FROM (SELECT DISTINCT set_name, element FROM live)) WHERE position <= 20", LIVE),
        "prefix_count": _with("SELECT set_name, count(DISTINCT element) AS n FROM live WHERE starts_with(element, '0000') GROUP BY set_name", LIVE),
        "batched_read": _with(
            "SELECT set_name, (k - 1) // 50 AS batch, count(*) AS n, min(element) AS first, max(element) AS last FROM (SELECT set_name, element, row_number() OVER (PARTITION BY set_name ORDER BY element) AS k FROM (SELECT DISTINCT set_name, element FROM live)) GROUP BY ALL", LIVE
        ),
        "least_last_frontier": _with("SELECT set_name, CASE WHEN count(*) = 2 THEN min(last) END AS frontier FROM (SELECT set_name, r, max(element) AS last FROM held WHERE r IN (0, 1) GROUP BY ALL) GROUP BY set_name"),
        "not_found_sets": _with("SELECT set_name FROM (SELECT unnest(['click', 'view', 'absent', 'missing']) AS set_name) WHERE set_name NOT IN (SELECT set_name FROM clock WHERE r = 0)"),
        "notfound_ok_read": _with(BY_ELEMENT.format("live1"), *MISSING),
        "notfound_repairs": _with("SELECT * FROM rep WHERE set_name = 'click'", *MISSING, REPAIRS.format(live="live1", held="held1")),
        "read_repairs": _with("SELECT * FROM rep", LIVE, REP),
        "repair_summary": _with("SELECT replica, action, count(*) AS n, count(DISTINCT (set_name, element)) AS n_elements FROM rep GROUP BY ALL", LIVE, REP),
        "repair_apply": _with(
            """SELECT r, count(*) AS n_held, count(x) AS n_common, (SELECT count(*) FROM live) AS n_live
FROM (SELECT r, set_name, element, actor, cnt FROM held WHERE r IN (0, 1)
      EXCEPT SELECT replica, set_name, element, actor, cnt FROM rep WHERE action = 'remove'
      UNION SELECT replica, set_name, element, actor, cnt FROM rep WHERE action = 'add')
LEFT JOIN (SELECT *, 1 AS x FROM live) USING (set_name, element, actor, cnt) GROUP BY r""",
            LIVE,
            REP,
        ),
        "clock_compress": _with(_packed("clock", "r, set_name")),
        "clock_expand": _with("SELECT DISTINCT set_name, actor, cnt FROM clock WHERE r = 0"),
        "clock_actors": _with("SELECT DISTINCT r, set_name, actor FROM clock"),
        "clock_merge": _with(_packed("(SELECT * FROM clock WHERE r IN (0, 1))")),
        "clock_intersection": _with(_packed("(SELECT * FROM c0 INTERSECT SELECT * FROM c1)"), C0, C1),
        "clock_complement": _with(_packed("(SELECT * FROM c1 EXCEPT SELECT * FROM c0)"), C0, C1),
        "clock_subtract": _with(_packed("(SELECT * FROM c0 EXCEPT SELECT set_name, actor, cnt FROM held WHERE r = 0)"), C0),
        "clock_compare": _with(
            " UNION ALL ".join([_compare(f"(SELECT * FROM clock WHERE r = {a})", f"(SELECT * FROM clock WHERE r = {b})", a, b) for a, b in ((0, 1), (0, 2), (1, 2))] + [_compare("(SELECT * FROM clock WHERE r < 2)", "(SELECT * FROM clock WHERE r = 0)", 9, 0)])
        ),
        "dots_seen": _with(
            "SELECT set_name, element, actor, cnt, coalesce(cnt <= base, false) AS contiguous FROM held h LEFT JOIN (SELECT set_name, actor, base FROM pk WHERE r = 0) USING (set_name, actor) WHERE r = 1 AND EXISTS (SELECT 1 FROM c0 WHERE c0.set_name = h.set_name AND c0.actor = h.actor AND c0.cnt = h.cnt)",
            C0,
            BASES,
        ),
        "dots_unseen": _with("SELECT set_name, element, actor, cnt FROM held h WHERE r = 1 AND NOT EXISTS (SELECT 1 FROM c0 WHERE c0.set_name = h.set_name AND c0.actor = h.actor AND c0.cnt = h.cnt)", C0),
        "contiguous_counter": _with("SELECT r, set_name, base FROM pk WHERE actor = 'r' || r", BASES),
        "get_dot": _with("SELECT s.set_name, 'r0' AS actor, coalesce(base, 0) AS cnt FROM (SELECT unnest(['click', 'absent']) AS set_name) s LEFT JOIN (SELECT * FROM pk WHERE r = 0 AND actor = 'r0') p USING (set_name)", BASES),
        "vv_merge": _with("SELECT set_name, string_agg(actor || ':' || base, ',' ORDER BY actor) AS merged FROM m GROUP BY set_name", VV),
        "vv_descends": _with(
            f"""SELECT set_name, {_descends('a', 'b')} AS a_b, {_descends('b', 'a')} AS b_a, {_descends('m', 'a')} AS m_a, ({_descends('m', 'b', True)}) AS m_over_b,
  (SELECT string_agg(actor || ':' || base, ',' ORDER BY actor) FROM a WHERE a.set_name = s.set_name) || ',r9:1' AS incremented
FROM (SELECT DISTINCT set_name FROM a) s""",
            VV,
        ),
        "ctx_dictionary": _with("SELECT * FROM dict", DICT),
        "ctx_encode": _with(f"SELECT set_name, element, string_agg({_ctx_hex()}, '' ORDER BY id, cnt) AS ctx FROM live JOIN dict USING (set_name, actor) GROUP BY ALL", LIVE, DICT),
        "ctx_decode": _with("SELECT live.* FROM live SEMI JOIN dict USING (set_name, actor)", LIVE, DICT),
        "encode_keys": _with(_all_keys(_nul)),
        "decode_keys": _with(KEY_ROWS),
        "encode_keys_lens": _with(_all_keys(_lens)),
        "decode_keys_lens": _with(KEY_ROWS),
        "key_order": _with(
            f"SELECT *, row_number() OVER (PARTITION BY set_name ORDER BY CASE kind WHEN 'clock' THEN 0 WHEN 'tombstone' THEN 1 WHEN 'element' THEN 2 ELSE 3 END, element, actor, cnt) AS place FROM ({KEY_ROWS}) WHERE set_name = '{RANGE_SET}'"
        ),
        "handoff_clock": _with(_packed("hclock"), HANDOFF),
        "handoff_tombstone": _with("SELECT * FROM htomb", HANDOFF),
        "handoff_value": _with(BY_ELEMENT.format("hvis"), HANDOFF),
        "handoff_scan": _with("SELECT *, 'r2' AS sender FROM ks", HANDOFF),
        "compact": _with("SELECT * FROM hvis", HANDOFF),
        "compaction_gain": _with(
            "SELECT set_name, count(*) AS n_before, count(v) AS n_after, count(*) - count(v) AS n_gone FROM hheld LEFT JOIN (SELECT *, 1 AS v FROM hvis) USING (set_name, element, actor, cnt) GROUP BY set_name", HANDOFF
        ),
        "tombstone_route": _with(
            "SELECT set_name, element, actor, cnt, CASE WHEN EXISTS (SELECT 1 FROM c0 WHERE c0.set_name = h.set_name AND c0.actor = h.actor AND c0.cnt = h.cnt) THEN 'tombstone' ELSE 'clock' END AS target FROM held h WHERE r = 1", C0
        ),
        "latency_stats": "SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, round(sum(value), 3) AS total, round(avg(value), 3) AS mean FROM events GROUP BY event_type",
        "latency_histogram": "SELECT event_type, CAST(floor(value / 25.0) * 25.0 AS DOUBLE) AS bucket, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL",
        "stream_state": _with(
            "SELECT r, set_name, count(*) AS n_seen, count(h) AS n_held FROM clock LEFT JOIN (SELECT *, 1 AS h FROM held) USING (r, set_name, element, actor, cnt) GROUP BY r, set_name"
        ),
    }
    epoch = " + ".join(["0", *[f"CASE WHEN replica = {r} AND op_id >= {n} THEN 1 ELSE 0 END" for r, starts in RESTARTS.items() for n in starts]])
    points = "points AS (SELECT * FROM (VALUES ('click', 'r0'), ('click', 'r1'), ('view', 'r2'), ('click', 'r9'), ('absent', 'r0')) t(set_name, actor))"
    point = "SELECT set_name, actor, base IS NULL AS fresh, coalesce(base, 0) AS base, coalesce(cloud, '') AS cloud, coalesce(n_gapped, 0) AS n_gapped FROM points LEFT JOIN ({}) USING (set_name, actor)"
    out |= {
        "actor_incarnations": _with(f"""SELECT op_id, set_name, element, actor, row_number() OVER (PARTITION BY set_name, actor ORDER BY op_id) AS cnt
FROM (SELECT *, 'r' || replica || CASE WHEN epoch > 0 THEN '.' || epoch ELSE '' END AS actor FROM (SELECT *, {epoch} AS epoch FROM ops WHERE op <> 'remove'))"""),
        "drop_replica": _with("SELECT r, set_name, count(*) AS n_seen, count(h) AS n_held FROM clock LEFT JOIN (SELECT *, 1 AS h FROM held) USING (r, set_name, element, actor, cnt) WHERE r <> 1 GROUP BY r, set_name"),
        "visible_ctx": _with("""SELECT op_id, count(*) AS n_dots, string_agg(actor || ':' || cnt, ',' ORDER BY actor, cnt) AS dots FROM ctx c JOIN (SELECT op_id, replica FROM ops) o USING (op_id)
WHERE NOT EXISTS (SELECT 1 FROM ctx x JOIN delivery d ON d.op_id = x.op_id WHERE d.r = o.replica AND x.set_name = c.set_name AND x.actor = c.actor AND x.cnt = c.cnt AND x.op_id < c.op_id)
GROUP BY op_id"""),
        "blind_remove": out["merged_read"],
        "coordinator_routing": _with("SELECT op_id, list_extract(p, k) AS coordinator, array_to_string(list_filter(p, lambda x: x <> list_extract(p, k)), ',') AS others FROM (SELECT op_id, [op_id % 64, (op_id + 1) % 64, (op_id + 2) % 64] AS p, op_id * 7 % 3 + 1 AS k FROM ops)"),
        "clock_runs": _with("SELECT r, set_name, actor, min(cnt) AS low, max(cnt) AS high FROM (SELECT *, cnt - row_number() OVER (PARTITION BY r, set_name, actor ORDER BY cnt) AS i FROM (SELECT DISTINCT r, set_name, actor, cnt FROM clock)) GROUP BY r, set_name, actor, i"),
        "clock_add_dots": _with(_packed("(SELECT * FROM c0 UNION SELECT set_name, actor, cnt FROM held WHERE r = 1)"), C0),
        "clock_from_vv": _with("SELECT set_name, actor, base, '' AS cloud, CAST(0 AS BIGINT) AS n_gapped FROM pk WHERE r = 0", BASES),
        "clock_point_get": _with(point.format(_packed("c0")), C0, points),
        "tombstone_point_get": _with(point.format(_packed("htomb")), HANDOFF, points),
        "clock_compare_relational": _with(f"SELECT set_name, only_a, only_b, relation FROM ({_compare('c0', 'c1', 0, 1)})", C0, C1),
        "vv_binary": _with(
            "SELECT set_name, '00000002' || string_agg(hex(actor) || lpad(printf('%X', base), 16, '0'), '' ORDER BY actor) AS packed, string_agg(actor || ':' || base, ',' ORDER BY actor) AS unpacked FROM pk WHERE r = 0 GROUP BY set_name", BASES
        ),
        "context_terms": _with("SELECT set_name, element, string_agg(actor || ':' || cnt, ',' ORDER BY actor, cnt) AS dots FROM held WHERE r = 0 GROUP BY ALL"),
        "clock_keys": _with(f"SELECT kind = 'clock' AND set_name = 'click' AND actor = 'r0' AS is_clock, count(*) AS n FROM (SELECT kind, set_name, coalesce(actor, '') AS actor FROM ({KEY_ROWS})) GROUP BY 1"),
        "dump_store": _with(
            f"""SELECT {_nul('65', 'element', 'actor', 'cnt')} AS key, 'element' AS kind, set_name, element, actor, cnt FROM held WHERE r = 0
UNION ALL SELECT DISTINCT {_nul('63', actor='actor')}, 'clock', set_name, NULL, actor, NULL FROM clock WHERE r = 0
UNION ALL SELECT DISTINCT {_nul('64', actor='actor')}, 'tombstone', set_name, NULL, actor, NULL FROM clock WHERE r = 0
UNION ALL SELECT DISTINCT {_nul('7A')}, 'end', set_name, NULL, NULL, NULL FROM clock WHERE r = 0"""
        ),
        "run_fold": _with("SELECT actor, count(*) AS n, CAST(sum(cnt) AS BIGINT) AS total FROM held WHERE r = 0 GROUP BY actor"),
        "store_size": _with(
            f"""SELECT set_name, false AS is_empty, count(*) AS n_keys, CAST(sum(length(key)) // 2 AS BIGINT) AS n_bytes FROM (
SELECT set_name, {_nul('65', 'element', 'actor', 'cnt')} AS key FROM held WHERE r = 0
UNION ALL SELECT set_name, {_nul('63', actor='actor')} FROM (SELECT DISTINCT set_name, actor FROM clock WHERE r = 0)
UNION ALL SELECT set_name, {_nul('64', actor='actor')} FROM (SELECT DISTINCT set_name, actor FROM clock WHERE r = 0)
UNION ALL SELECT set_name, {_nul('7A')} FROM (SELECT DISTINCT set_name FROM clock WHERE r = 0)) GROUP BY set_name"""
        ),
        "handoff_senders": _with(BY_ELEMENT.format("hvis"), SENDERS),
        "handoff_stream": _with("""SELECT 'r' || s.r AS sender, s.set_name, s.actor, s.cnt FROM clock s WHERE s.r IN (1, 2)
AND NOT EXISTS (SELECT 1 FROM held h WHERE h.r = s.r AND h.set_name = s.set_name AND h.actor = s.actor AND h.cnt = s.cnt)
AND EXISTS (SELECT 1 FROM clock c WHERE c.r = 0 AND c.set_name = s.set_name AND c.actor = s.actor AND c.cnt = s.cnt)"""),
        "random_set": "SELECT id AS position, substr(sha256('7-' || id || '-0') || sha256('7-' || id || '-1'), 1, 100) AS element FROM range(1000) t(id)",
        "random_batches": "SELECT id AS batch, CAST(50 AS BIGINT) AS n, CAST(50 AS BIGINT) AS n_distinct FROM range(20) t(id)",
    }
    out |= {f"{name}_relational": out[name] for name in ("clock_merge", "clock_intersection", "clock_complement", "dots_seen")}
    out["merged_read_relational"] = out["merge_dots_arrays"] = out["merged_read"]
    out |= {f"{name}_relational": out[name] for name in ("read_repairs", "repair_apply", "handoff_value")}
    orders = "events AS (SELECT o_orderkey AS event_id, o_orderpriority AS event_type, o_custkey AS user_id FROM orders), "
    out["orders_merged_read"] = "WITH " + orders + out["merged_read"].removeprefix("WITH ")
    return out
