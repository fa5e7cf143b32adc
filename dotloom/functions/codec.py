"""Binary keys of the ordered store, as column expressions.

Two layouts. ``nul``: fields parted by NUL with a trailer of field lengths; ``lens``: fields behind
their lengths. Decoders take keys of the same layout apart again. Order of results is always that
of the decoded columns, never of bytes, for elements may hold NUL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the key formats.
MAGIC, VERSION, NUL = "01", "01", "00"
KINDS = {"clock": "63", "tombstone": "64", "element": "65", "end": "7A"}


def _hex(h: str) -> Column:
    return F.unhex(F.lit(h))


def _bytes(c: Column) -> Column:
    return c.cast("binary")


def be64(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 16, "0"))


def be32(n: Column) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 8, "0"))


def _swapped(c: Column, size: int) -> Column:
    return F.concat(*[F.substring(c, i, 1) for i in range(size, 0, -1)])


def le64(n: Column) -> Column:
    return _swapped(be64(n), 8)


def le32(n: Column) -> Column:
    return _swapped(be32(n), 4)


def unsigned(c: Column) -> Column:
    """A big-endian field of up to 63 bits as a number."""
    return F.conv(F.hex(c), 16, 10).cast("long")


def nul_key(kind: str, set_name: Column, element: Column | None = None, actor: Column | None = None, cnt: Column | None = None) -> Column:
    """Magic, version, set, kind, element, actor, counter (elements only), parted by NUL; then three lengths."""
    none = F.unhex(F.lit(""))
    s, e, a = _bytes(set_name), none if element is None else _bytes(element), none if actor is None else _bytes(actor)
    nul = _hex(NUL)
    tail = [nul, be64(cnt), nul] if kind == "element" else [nul, nul]
    lengths = [be64(F.octet_length(x)) for x in (s, e, a)]
    return F.concat(_hex(MAGIC + VERSION), s, nul, _hex(KINDS[kind]), nul, e, nul, a, *tail, *lengths)


def decode_nul(keys: DataFrame, column: str = "key") -> DataFrame:
    """Adds kind, set_name, element, actor, cnt; absent fields are null."""
    k, n = F.col(column), F.octet_length(column)
    d = keys.withColumns({"__s": unsigned(F.substring(k, n - 23, F.lit(8))).cast("int"), "__e": unsigned(F.substring(k, n - 15, F.lit(8))).cast("int"), "__a": unsigned(F.substring(k, n - 7, F.lit(8))).cast("int")})
    s, e, a = F.col("__s"), F.col("__e"), F.col("__a")
    kind = F.hex(F.substring(k, s + 4, F.lit(1)))
    name = F.lit(None).cast("string")
    for what, code in KINDS.items():
        name = F.when(kind == code, what).otherwise(name)
    text = lambda at, size: F.substring(k, at, size).cast("string")
    out = d.withColumn("kind", name).withColumn("set_name", text(F.lit(3), s))
    is_element = F.col("kind") == "element"
    out = out.withColumn("element", F.when(is_element, text(s + 6, e)))
    out = out.withColumn("actor", F.when(F.col("kind") != "end", text(s + e + 7, a)))
    out = out.withColumn("cnt", F.when(is_element, unsigned(F.substring(k, s + e + a + 8, F.lit(8)))))
    return out.drop("__s", "__e", "__a")


def lens_key(kind: str, set_name: Column, element: Column | None = None, actor: Column | None = None, cnt: Column | None = None) -> Column:
    """Each field behind its little-endian length."""
    sized = lambda c: F.concat(le32(F.octet_length(c)), c)
    head = F.concat(sized(_bytes(set_name)), _hex(KINDS[kind]))
    if kind == "element":
        return F.concat(head, sized(_bytes(element)), sized(_bytes(actor)), le64(cnt))
    return head if actor is None else F.concat(head, _bytes(actor))


def decode_lens(keys: DataFrame, column: str = "key") -> DataFrame:
    """Adds kind, set_name, element, actor, cnt; absent fields are null."""
    k = F.col(column)
    number = lambda at, size: unsigned(F.concat(*[F.substring(k, at + (size - 1 - i), F.lit(1)) for i in range(size)]))
    d = keys.withColumn("__s", number(F.lit(1), 4).cast("int"))
    s = F.col("__s")
    kind = F.hex(F.substring(k, s + 5, F.lit(1)))
    name = F.lit(None).cast("string")
    for what, code in KINDS.items():
        name = F.when(kind == code, what).otherwise(name)
    text = lambda at, size: F.substring(k, at, size).cast("string")
    d = d.withColumn("kind", name).withColumn("set_name", text(F.lit(5), s))
    is_element = F.col("kind") == "element"
    d = d.withColumn("__e", F.when(is_element, number(s + 6, 4).cast("int")))
    e = F.col("__e")
    d = d.withColumn("__a", F.when(is_element, number(s + e + 10, 4).cast("int")))
    a = F.col("__a")
    d = d.withColumn("element", F.when(is_element, text(s + 10, e)))
    rest = F.when(F.col("kind") != "end", text(s + 6, F.octet_length(k)))
    d = d.withColumn("actor", F.when(is_element, text(s + e + 14, a)).otherwise(rest))
    d = d.withColumn("cnt", F.when(is_element, number(s + e + a + 14, 8)))
    return d.drop("__s", "__e", "__a")


def is_clock_key(key: Column, set_name: Column, actor: Column) -> Column:
    return key == nul_key("clock", set_name, None, actor)


#: The two layouts behind one interface.
LAYOUTS = {"nul": (nul_key, decode_nul), "lens": (lens_key, decode_lens)}


def maker(layout: str):
    """The key builder of a layout."""
    if layout not in LAYOUTS:
        raise ValueError(f"layout must be one of {sorted(LAYOUTS)}")
    return LAYOUTS[layout][0]


def decode(keys: DataFrame, layout: str, column: str = "key") -> DataFrame:
    """Keys of a layout with kind, set_name, element, actor, cnt."""
    maker(layout)
    return LAYOUTS[layout][1](keys, column)


def to_term(*columns: Column) -> Column:
    """Any columns as bytes: JSON of a struct."""
    return F.to_json(F.struct(*columns)).cast("binary")


def from_term(term: Column, schema: str) -> Column:
    """The struct again; null if the bytes are none."""
    return F.from_json(term.cast("string"), schema)
