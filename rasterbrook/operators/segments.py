"""Stages on marker segments and scans: byte stuffing, restart order, table versions, component references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rasterbrook.operators import scan


def _pairs(hexadecimal: Column) -> Column:
    return F.filter(F.split(hexadecimal, "(?<=\\G..)"), lambda x: x != "")


def destuffed(hexadecimal: Column) -> Column:
    """Hexadecimal entropy bytes without the 00 behind each FF."""
    pairs = _pairs(hexadecimal)
    before = F.concat(F.array(F.lit("")), pairs)
    kept = F.filter(F.transform(pairs, lambda x, i: F.when((x == "00") & (F.get(before, i) == "FF"), "").otherwise(x)), lambda x: x != "")
    return F.array_join(kept, "")


def markers_in(df: DataFrame, by: list[str], hexadecimal: str) -> DataFrame:
    """(by, offset, marker): every FF xx in a byte string but stuffed FF00 and fill bytes."""
    pairs = df.select(*by, _pairs(F.col(hexadecimal)).alias("b"))
    found = F.filter(F.transform("b", lambda x, i: F.struct(i.alias("offset"), F.get("b", i + 1).alias("marker"), x.alias("x"))), lambda x: (x["x"] == "FF") & x["marker"].isNotNull() & ~x["marker"].isin("00", "FF"))
    return pairs.select(*by, F.explode(found).alias("m")).select(*by, F.col("m.offset").alias("offset"), F.conv("m.marker", 16, 10).cast("int").alias("marker"))


def restart_check(markers: DataFrame, by: list[str]) -> DataFrame:
    """Restart markers (by, offset, marker) with expected and ok: they must count up from 0xD0, modulo eight."""
    rst = markers.filter(F.col("marker").between(0xD0, 0xD7))
    counted = scan.running_sum(rst, by, "offset", {"_turn": F.lit(1)}, inclusive=False, stretch=1 << 20)
    return counted.withColumn("expected", (F.lit(0xD0) + F.col("_turn") % 8).cast("int")).withColumn("ok", F.col("marker") == F.col("expected")).drop("_turn")


def table_version(scans: DataFrame, tables: DataFrame, by: list[str], slot: str, offset: str = "offset") -> DataFrame:
    """scans with version: offset of the newest table of its slot defined before it, null if there is none.

    An as-of join without a range condition: both sides in one ordered window, so a key's rows are read once.
    """
    keys = [*by, slot]
    rest = [c for c in scans.columns if c not in (*keys, offset)]
    left = scans.select(*keys, offset, F.struct(*rest).alias("rest") if rest else F.struct(F.lit(1)).alias("rest"), F.lit(True).alias("scan"))
    right = tables.select(*keys, offset, F.lit(None).alias("rest"), F.lit(False).alias("scan"))
    # of equal offsets the scan comes first: a table counts from behind its own place
    w = Window.partitionBy(*keys).orderBy(F.col(offset), F.desc("scan")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = left.unionByName(right.withColumn("rest", F.lit(None).cast(left.schema["rest"].dataType)))
    seen = both.withColumn("version", F.last(F.when(~F.col("scan"), F.col(offset)), ignorenulls=True).over(w))
    return seen.filter("scan").select(*keys, offset, *([F.col(f"rest.`{c}`").alias(c) for c in rest]), "version")


def last_values(rows: DataFrame, by: list[str], order: str, slot: str, value: str, slots: list[str]) -> DataFrame:
    """rows with a column for each slot: its last value among the rows before, null if there is none. One window for all slots; a slot's rows are those that name it."""
    w = Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumns({s: F.last(F.when(F.col(slot) == s, F.col(value)), ignorenulls=True).over(w) for s in slots})


def resolved(definitions: DataFrame, scans: DataFrame, frames: DataFrame, by: list[str]) -> DataFrame:
    """A row per scan component with the tables that hold for it: by, offset, ord, comp_id, quant, dc, ac (their segments' offsets), interval, error.

    definitions (by, offset, slot, value): slots q0 to q3, d0 to d3, a0 to a3 with
    the offset as value, r with the restart interval; of one offset there may be
    several. scans (by, offset, ord, comp_id, dc, ac) and frames (by, comp_id,
    quant) hold selectors. A scan that names no component of the frame, or a
    table that isn't defined before it, has an error.
    """
    slots = [f"{kind}{i}" for kind in "qda" for i in range(4)] + ["r"]
    places = scans.select(*by, "offset").distinct().withColumns({"slot": F.lit("scan"), "value": F.lit(None).cast("long")})
    events = definitions.select(*by, "offset", "slot", F.col("value").cast("long").alias("value")).unionByName(places)
    held = last_values(events, by, "offset", "slot", "value", slots).filter("slot = 'scan'").select(*by, "offset", *slots)
    named = scans.join(frames.select(*by, "comp_id", "quant", F.lit(True).alias("_found")), [*by, "comp_id"], "left").join(held, [*by, "offset"])
    of = lambda kind, at: F.get(F.array(*(F.col(f"{kind}{i}") for i in range(4))), at)
    chosen = named.select(*by, "offset", "ord", "comp_id", of("q", F.col("quant")).alias("quant"), of("d", F.col("dc")).alias("dc"), of("a", F.col("ac")).alias("ac"), F.coalesce("r", F.lit(0)).alias("interval"), "_found")
    missing = F.col("quant").isNull() | F.col("dc").isNull() | F.col("ac").isNull()
    error = F.when(F.col("_found").isNull(), "the scan names no component of the frame").when(missing, "the scan needs a table that is not defined")
    return chosen.withColumn("error", error).drop("_found")


def unresolved(references: DataFrame, definitions: DataFrame, on: list[str]) -> DataFrame:
    """References to nothing that is defined."""
    return references.join(definitions.select(*on).distinct(), on, "left_anti")


def component_lookup(references: DataFrame, components: DataFrame, on: list[str]) -> DataFrame:
    """references with the component's columns, and error where there is none."""
    marked = components.withColumn("_found", F.lit(True))
    joined = references.join(marked, on, "left")
    return joined.withColumn("error", F.when(F.col("_found").isNull(), "no such component")).drop("_found")


def mcu_grid(width: Column, height: Column, h: Column, v: Column) -> tuple[Column, Column]:
    """MCUs in a row, and rows of them."""
    return F.ceil(width / (8 * h)).cast("int"), F.ceil(height / (8 * v)).cast("int")


def component_roles(components: DataFrame, image: str = "image_id") -> DataFrame:
    """Frame components (image_id, ord, comp_id, h, v) with role Y, Cb, Cr and error.

    Exactly three; at most one is sampled more finely, and it is the luma; otherwise the first is.
    """
    w = Window.partitionBy(image)
    fine = F.col("h") * F.col("v") > 1
    n_fine = F.sum(fine.cast("int")).over(w)
    checked = components.withColumns({"_n": F.count("*").over(w), "_fine": n_fine, "_first": F.min(F.when(fine, F.col("ord"))).over(w)})
    luma = F.coalesce("_first", F.min("ord").over(w))
    error = F.when(F.col("_n") != 3, "three components are needed").when(F.col("_fine") > 1, "more than one component is subsampled").when(luma != F.min("ord").over(w), "the subsampled component is not the first")
    role = F.element_at(F.array(F.lit("Y"), F.lit("Cb"), F.lit("Cr")), F.row_number().over(w.orderBy((F.col("ord") != F.col("_luma")).cast("int"), "ord")))
    staged = checked.withColumn("_luma", luma).withColumn("error", error)
    return staged.withColumn("role", F.when(F.col("error").isNull(), role)).drop("_n", "_fine", "_first", "_luma")
