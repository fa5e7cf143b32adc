"""Version vectors as maps actor -> counter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vv_merge(a: Column, b: Column) -> Column:
    """Pointwise maximum."""
    return F.map_zip_with(a, b, lambda _, x, y: F.greatest(F.coalesce(x, F.lit(0)), F.coalesce(y, F.lit(0))))


def vv_descends(a: Column, b: Column) -> Column:
    """Whether a has at least all of b."""
    return F.forall(F.map_entries(b), lambda e: F.coalesce(F.element_at(a, e["key"]) >= e["value"], F.lit(False)))


def vv_dominates(a: Column, b: Column) -> Column:
    return vv_descends(a, b) & ~vv_descends(b, a)


def vv_increment(a: Column, actor: Column) -> Column:
    """a with the actor's counter one higher."""
    more = F.create_map(actor, F.coalesce(F.try_element_at(a, actor), F.lit(0)) + 1)
    return vv_merge(a, more)


def vv_text(a: Column) -> Column:
    """actor:counter pairs in order of actors."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(a)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")


def vv_new() -> Column:
    return F.create_map().cast("map<string,bigint>")


def vv_pack(a: Column, size: int) -> Column:
    """Bytes of a vector whose actors all take ``size`` bytes: the size, then actor and counter by order of actors."""
    fits = F.forall(F.map_keys(a), lambda k: F.octet_length(k) == size)
    entry = lambda e: F.concat(F.hex(e["key"].cast("binary")), F.lpad(F.hex(e["value"]), 16, "0"))
    packed = F.unhex(F.concat(F.lit(f"{size:08X}"), F.array_join(F.transform(F.array_sort(F.map_entries(a)), entry), "")))
    return F.when(fits, packed).otherwise(F.raise_error(F.lit(f"actors must take {size} bytes")).cast("binary"))


def vv_unpack(packed: Column) -> Column:
    """The vector of packed bytes."""
    digits = F.hex(packed)
    number = lambda h: F.conv(h, 16, 10).cast("long")
    size = number(F.substring(digits, 1, 8)).cast("int")
    width = size * 2 + 16
    # Characters in groups of an entry's width.
    entries = F.regexp_extract_all(F.substring(digits, F.lit(9), F.length(digits)), F.concat(F.lit("(.{"), width.cast("string"), F.lit("})")), F.lit(1))
    entry = lambda e: F.struct(F.unhex(F.substring(e, F.lit(1), F.length(e) - 16)).cast("string"), number(F.right(e, F.lit(16))))
    return F.map_from_entries(F.transform(entries, entry))
