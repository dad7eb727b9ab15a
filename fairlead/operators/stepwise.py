"""Rules that walk along rows with one number as their state, taken slice by slice.

What a stretch of rows makes of the state before it is a function of that state. For rules whose rows either leave
the state or set it, that function is made of few pieces, each of which gives a constant or leaves the state as it
is; so is one such function after another. A slice is folded to its function by its own task, the functions of a
boat's slices (one small row each) are followed in order, and every slice then starts from its own state.

A function is a column of pieces (lo, hi, v): for lo <= state < hi the state becomes v, or stays where v is null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.operators.scan import settle

#: Beyond all states; LEAST is the state before the first row.
MOST = 1 << 62
LEAST = -MOST
PIECES = "array<struct<lo:bigint,hi:bigint,v:bigint>>"
#: Items folded and unfolded at once inside a slice.
CHUNK = 64


def _piece(lo: Column, hi: Column, v: Column) -> Column:
    return F.struct(lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"), v.cast("bigint").alias("v"))


def sets_outside(value: Column, stays_below: Column) -> Column:
    """The function that leaves a state above ``value`` and below ``stays_below``, and else gives ``value``."""
    top = F.greatest(value + 1, stays_below)
    all_ = F.array(_piece(F.lit(LEAST), value + 1, value), _piece(value + 1, top, F.lit(None)), _piece(top, F.lit(MOST), value))
    return F.filter(all_, lambda p: p["lo"] < p["hi"])


def identity() -> Column:
    return F.array(_piece(F.lit(LEAST), F.lit(MOST), F.lit(None))).cast(PIECES)


def apply(f: Column, state: Column) -> Column:
    hit = F.filter(f, lambda p: (p["lo"] <= state) & (state < p["hi"]))
    return F.coalesce(F.get(hit, F.lit(0))["v"], state)


def _joined(pieces: Column) -> Column:
    """Neighbours with one value as one piece."""

    def add(out: Column, p: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        longer = F.concat(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), F.array(_piece(last["lo"], p["hi"], p["v"])))
        return F.when((F.size(out) > 0) & (last["v"] == p["v"]), longer).otherwise(F.concat(out, F.array(p)))

    return F.aggregate(pieces, F.array().cast(PIECES), add)


def then(f: Column, g: Column) -> Column:
    """First f, then g."""

    def follow(p: Column) -> Column:
        inside = F.transform(g, lambda q: _piece(F.greatest(p["lo"], q["lo"]), F.least(p["hi"], q["hi"]), q["v"]))
        fixed = F.array(_piece(p["lo"], p["hi"], apply(g, p["v"])))
        return F.when(p["v"].isNull(), F.filter(inside, lambda q: q["lo"] < q["hi"])).otherwise(fixed)

    return _joined(F.flatten(F.transform(f, follow)))


def _folded(items: Column) -> Column:
    """The function of items (no, f) in order."""
    return F.aggregate(items, identity(), lambda f, x: then(f, x["f"]).cast(PIECES))


def _walked(items: Column, state: Column, kind: str) -> Column:
    """Items' numbers, each with the state before it."""
    none = F.array().cast(f"array<struct<no:{kind},entry:bigint>>")
    start = F.struct(state.cast("bigint").alias("state"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = F.struct(x["no"].cast(kind).alias("no"), acc["state"].alias("entry"))
        return F.struct(apply(x["f"], acc["state"]).alias("state"), F.concat(acc["out"], F.array(here)).alias("out"))

    return F.aggregate(items, start, step, lambda acc: acc["out"])


def _in_order(no: str, f: str) -> Column:
    return F.array_sort(F.collect_list(F.struct(F.col(no).alias("no"), F.col(f).alias("f"))))


def entry_states(items: DataFrame, keys: list[str], slice_col: str) -> DataFrame:
    """For items (keys, slice, no, f) the state before each: keys, slice, no, entry. ``no`` counts an item inside
    its slice. At the start of a key the state is LEAST."""
    part = [*keys, slice_col]
    kind = items.schema[slice_col].dataType.simpleString()
    by_chunk = items.withColumn("_chunk", F.floor(F.col("no") / CHUNK)).groupBy(*part, "_chunk").agg(_in_order("no", "f").alias("items"))
    chunks = settle(by_chunk.withColumn("f", _folded(F.col("items"))))
    slices = chunks.groupBy(*part).agg(_in_order("_chunk", "f").alias("chunks"))
    slices = settle(slices.withColumn("f", _folded(F.col("chunks"))))
    whole = slices.groupBy(*keys).agg(_in_order(slice_col, "f").alias("slices"))
    entries = whole.select(*keys, F.explode(_walked(F.col("slices"), F.lit(LEAST), kind)).alias("s")).select(*keys, F.col("s.no").alias(slice_col), "s.entry")
    inner = slices.join(entries, part).select(*part, F.explode(_walked(F.col("chunks"), F.col("entry"), "bigint")).alias("s"))
    inner = inner.select(*part, F.col("s.no").alias("_chunk"), "s.entry")
    each = chunks.select(*part, "_chunk", "items").join(inner, [*part, "_chunk"])
    return each.select(*part, F.explode(_walked(F.col("items"), F.col("entry"), "bigint")).alias("s")).select(*part, "s.no", "s.entry")
