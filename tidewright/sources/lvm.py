"""LabVIEW measurement text: a global header, then segments of a header, column names and rows.

One plan reads all segments. Every line learns its segment and its place among the lines of all bodies from
running counts: of those within its block of the file, and of all blocks before it (one row for each). Lines
with both are written once; header fields and column names become one row for each segment, written too, which
its rows are joined with. A row's number is its place less the lines of names up to it, so nothing is counted
over segments. The number of jobs doesn't depend on the number of segments, and a segment of any length spreads
over as many tasks as it has blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright import files
from tidewright.functions import number

END, CHANNELS = "***End_of_Header***", "Channels"
#: Separators by name; rows are always cut at tabs.
SEPARATORS = {"tab": "\t", "comma": ",", "semicolon": ";"}
#: Header fields of a segment, in the order of its description.
FIELDS = {"channels": "Channels", "samples": "Samples", "date": "Date", "time": "Time", "x_columns": "X_Columns", "x0": "X0", "delta_x": "Delta_X"}
BOM = "﻿"


def _blocks(text: DataFrame) -> DataFrame:
    """(file, block, nb, ends0, seg0, head0): blocks numbered in order, and what lies before each of them; one row for each.

    Only the lines that begin and end headers are looked at.
    """
    w = Window.partitionBy("file", "block").orderBy("pos")
    x = text.where("is_end or is_start").select("file", "block", "pos", F.col("is_end").cast("long").alias("is_end"), F.col("is_start").cast("long").alias("is_start"))
    # Within a block: ends of headers before the line, and lines that may begin a segment, all or those after the first end.
    x = x.withColumn("ends", F.sum("is_end").over(w) - F.col("is_end"))
    later = F.when(F.col("ends") > 0, F.col("is_start")).otherwise(0)
    last = lambda c: F.max(F.when(c > 0, F.col("ends")))
    found = x.groupBy("file", "block").agg(F.sum("is_end").alias("n_ends"), F.sum("is_start").alias("n"), F.sum(later).alias("n_later"), last(F.col("is_start")).alias("last"), last(later).alias("last_later"))
    blocks = text.select("file", "block").distinct().join(found, ["file", "block"], "left").na.fill(0, ["n_ends", "n", "n_later"])
    upto = Window.orderBy("file", "block")
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns({"nb": F.row_number().over(upto).cast("long"), "ends0": F.coalesce(F.sum("n_ends").over(before), F.lit(0))})
    open_ = F.col("ends0") > 0
    blocks = blocks.withColumns({"n": F.when(open_, F.col("n")).otherwise(F.col("n_later")), "last": F.col("ends0") + F.when(open_, F.col("last")).otherwise(F.col("last_later"))})
    return blocks.select("file", "block", "nb", "ends0", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seg0"), F.max("last").over(before).alias("head0"))


def marked(spark: SparkSession, path: str) -> DataFrame:
    """(at, seg, kind, n, line): lines in the order of ``at`` with their segment, 0 for the global header.

    Kinds: h in a header, n a body's line that follows a header or is the first of its block (column names are among
    those), b any other one of a body; n counts the lines of all bodies up to this one. ``path`` is a file or a folder
    of parts, which follow one another by name. Blank lines of bodies and what stands between the global header and the
    first segment are left out.
    """
    line = F.when(F.col("value").endswith("\r"), F.regexp_replace("value", "\r$", "")).otherwise(F.col("value"))
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("pos"), line.alias("line"))
    text = text.withColumn("key", _key("line")).select("file", "block", "pos", "line", (F.col("key") == END).alias("is_end"), (F.col("key") == CHANNELS).alias("is_start"))
    # One row for each block of the file.
    x = text.join(F.broadcast(_blocks(text)), ["file", "block"]).select("nb", "ends0", "seg0", "head0", "pos", "line", "is_end", "is_start")
    order = Window.partitionBy("nb").orderBy("pos")
    w = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = x.withColumns({"ends": F.col("ends0") + F.count_if("is_end").over(w) - F.col("is_end").cast("long"), "nr": F.row_number().over(order)})
    starts = F.col("is_start") & (F.col("ends") > 0)
    x = x.withColumns({"seg": F.col("seg0") + F.count_if(starts).over(w), "begun": F.coalesce(F.max(F.when(starts, F.col("ends"))).over(w), F.col("head0"))})
    # A line is in its segment's header while no header has ended since the segment began.
    header = F.when(F.col("seg") == 0, F.col("ends") == 0).otherwise(F.col("ends") == F.col("begun"))
    x = x.withColumn("kind", F.when(header, "h").when((F.col("seg") > 0) & F.col("line").rlike(r"\S"), "b")).where("kind is not null")
    x = x.withColumns({"n": F.count_if(F.col("kind") == "b").over(w), "prior": F.lag("kind").over(order)})
    kind = F.when((F.col("kind") == "b") & (F.coalesce("prior", F.lit("h")) == "h"), "n").otherwise(F.col("kind"))
    x = files.kept(x.select("nb", (F.shiftleft("nb", 32) + F.col("nr")).alias("at"), "seg", kind.alias("kind"), "n", "line"))
    before = Window.orderBy("nb").rowsBetween(Window.unboundedPreceding, -1)
    earlier = x.groupBy("nb").agg(F.max("n").alias("own")).select("nb", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("n0"))
    return x.join(F.broadcast(earlier), "nb").select("at", "seg", "kind", (F.col("n0") + F.col("n")).alias("n"), "line")


def _key(line: str) -> Column:
    return F.trim(F.replace(F.substring_index(line, "\t", 1), F.lit(BOM), F.lit("")))


@dataclass(frozen=True)
class Parsed:
    """lines; heads (a row for each segment: seg, the FIELDS, names, base); rows (row_idx, cells as strings); columns; the global header."""

    lines: DataFrame
    heads: DataFrame
    rows: DataFrame
    columns: list[str]
    glob: dict[str, str | None]


def _first(fields: Column) -> Column:
    """The first value that isn't empty."""
    return F.get(F.filter(fields, lambda v: v != ""), F.lit(0))


def parsed(spark: SparkSession, path: str) -> Parsed:
    lines = marked(spark, path)
    f = F.split("line", "\t", -1)
    fields = lines.where("kind = 'h'").select("seg", "at", _key("line").alias("key"), _first(F.transform(F.slice(f, 2, F.size(f)), lambda v: F.trim(v))).alias("value"))
    # A key's last line counts. Null fields too: END itself is one.
    glob = {r["key"]: r["value"] for r in fields.where("seg = 0 and key <> ''").groupBy("key").agg(F.max_by("value", "at").alias("value")).collect()}
    if END not in glob:
        raise ValueError(f"LVM header did not contain {END}")

    names = lines.where("kind = 'n'").select("seg", "n", F.transform(F.split("line", "\t", -1), lambda v: F.trim(v)).alias("names"))
    told = fields.where(F.col("seg") > 0).where(F.col("key").isin(END, *FIELDS.values())).withColumns({"n": F.lit(None).cast("long"), "names": F.lit(None).cast("array<string>")})
    both = told.unionByName(names, allowMissingColumns=True).groupBy("seg").agg(
        *[F.max_by("value", F.when(F.col("key") == v, F.col("at"))).alias(k) for k, v in FIELDS.items()], (F.count_if(F.col("key") == END) > 0).alias("ended"), F.min("n").alias("base"), F.min_by("names", "n").alias("names"))
    x_columns = F.coalesce(F.col("x_columns"), F.lit(glob.get("X_Columns")))
    heads = files.kept(both.withColumn("x_columns", x_columns).withColumn("rebuilt", F.coalesce(F.lower("x_columns") == "no", F.lit(False))))
    missing = lambda k: F.count_if(F.col("rebuilt") & F.col(k.lower()).isNull()).alias(k)
    told = heads.agg(F.count("*").alias("n"), F.count_if(~F.col("ended")).alias("open"), F.count_if(F.col("names").isNull()).alias("empty"), missing("X0"), missing("Delta_X")).first()
    if not told["n"]:
        raise ValueError(f"No tabular data segments were found in LVM file: {path}")
    if told["open"]:
        raise ValueError(f"LVM header did not contain {END}")
    if told["empty"]:
        raise ValueError("LVM segment ended before the tabular data header row")
    for k in ("X0", "Delta_X"):
        if told[k]:
            raise ValueError(f"LVM segment is missing required metadata field: {k}")
    # A row for each column name; first come, first.
    found = heads.groupBy("names").agg(F.min("seg").alias("seg")).select("seg", F.posexplode("names").alias("place", "name")).groupBy("name").agg(F.min(F.struct("seg", "place")).alias("first"))
    columns = [r["name"] for r in found.orderBy("first").collect()]

    separator, decimal = SEPARATORS.get((glob.get("Separator") or "Tab").lower(), "\t"), glob.get("Decimal_Separator") or "."
    body = lines.where("kind <> 'h'").select("seg", "n", "line")
    x = body.join(heads.select("seg", "names", "base", "rebuilt", *[(F.replace(F.col(k), F.lit(decimal), F.lit(".")).cast("double")).alias(k) for k in ("x0", "delta_x")]), "seg").where("n > base")
    x = x.withColumn("i", F.col("n") - F.col("base") - 1)
    tidy = lambda c: F.nullif(F.trim(c), F.lit(""))
    put = lambda c: F.replace(tidy(c), F.lit(decimal), F.lit(".")) if decimal != "." else tidy(c)
    rebuilt = (F.col("x0") + F.col("i") * F.col("delta_x")).cast("string")
    # As many cells as names: what a long row has too much stays in its last cell, tabs and all.
    cut = F.split("line", "\t", F.size("names"))
    cells = F.transform(cut, lambda v, k: F.when(F.col("rebuilt") & (k == 0), rebuilt).otherwise(put(F.replace(v, F.lit("\t"), F.lit(separator)))))
    # Each segment up to this one has one line of names. Cells are written once, so that no line is cut again for each column.
    x = files.kept(x.select((F.col("n") - 1 - F.col("seg")).alias("row_idx"), "names", cells.alias("cells")))

    def cell(name: str) -> Column:
        place = F.array_position("names", name)
        return F.when(place > 0, F.get("cells", (place - 1).cast("int")))

    rows = x.select("row_idx", F.struct(*[cell(c).alias(f"c{k}") for k, c in enumerate(columns)]).alias("cells"))
    return Parsed(lines, heads, rows, columns, glob)


def table(spark: SparkSession, path: str, got: Parsed | None = None) -> DataFrame:
    """Rows of all segments by column name, with row_idx. A column is numeric where all its values are.

    Where a segment's X_Columns (or else the global one) says No, its first column is X0 + i * Delta_X. Short
    rows are filled, and what a long row has too much is joined to its last cell by the declared separator.
    """
    got = got or parsed(spark, path)
    cells = [F.col("cells").getField(f"c{k}") for k in range(len(got.columns))]
    numeric = got.rows.agg(*[(F.count(number(c)) == F.count(c)).alias(f"c{k}") for k, c in enumerate(cells)]).first()
    return got.rows.select("row_idx", *[(number(c) if on else c).alias(name) for c, on, name in zip(cells, numeric, got.columns, strict=True)])


def segments(got: Parsed) -> DataFrame:
    """(segment, channels, samples, date, time, x_columns, x0, delta_x): what each segment's header says."""
    return got.heads.select(F.col("seg").alias("segment"), *FIELDS)


def read(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    """(table in order, metadata): as ``table``, and one description for each segment."""
    got = parsed(spark, path)
    described = [r.asDict() for r in segments(got).orderBy("segment").drop("segment").collect()]
    return table(spark, path, got).orderBy("row_idx").drop("row_idx"), {"global_header": got.glob, "segment_count": len(described), "segments": described}


def segment_time(rows: DataFrame, segment: str, order: str, x0, dx, into: str) -> DataFrame:
    """Sets ``into`` to x0 + i * dx, i from 0 in each segment."""
    lit = lambda v: F.col(v) if isinstance(v, str) else F.lit(float(v))
    i = F.row_number().over(Window.partitionBy(segment).orderBy(order)) - 1
    return rows.withColumn(into, lit(x0) + i * lit(dx))
