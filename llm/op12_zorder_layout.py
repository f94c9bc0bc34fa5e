"""Clustered layout of documents by four values: a sixteen-ary trie over the digits of z, with subtree counts.

**Coordinates.** A value's coordinate is floor(16 * smaller / rows). Distinct values with their counts are
range-partitioned in order, and sums of whole partitions and inside each give the number of smaller rows. Only the
least value of each coordinate is fetched: at most 64 rows.

**Trie.** Each z-digit holds one bit of each coordinate, so four digits give z and the trie has at most 16 + 256 +
4,096 + 65,536 nodes, however many rows there are. Rows are counted by cell, cells by node; the descent gives a child
its parent's offset and the counts of its lesser siblings, and so a cell its first position.

**Positions.** Rows are range-partitioned by (z, doc_id), which also splits a cell that holds most rows. A row's rank
in its cell is its place in the partition, less that of the cell's first row there, plus the cell's rows in earlier
partitions. Rows that agree in both take the positions in any order, which leaves the result the same.

**Queries.** All rows of a cell ask the same box, so there are at most 65,536 queries. Each descends the trie through
the nodes that meet its box and collects the file intervals of the cells it ends in; their union is
``files_matching``. Files are taken from the cells' intervals too: one that lies inside a cell has that cell's
bounds, all others hold an end of some cell. ``files_touched`` counts files whose bounds meet a box, so each
distinct bounds, widened by the box's reach, adds its number of files to the corners of a range in the grid of 65,536
cells, and running sums along the four axes give every query its count at once, with no pair of file and query made.

What is broadcast is a trie level (at most 65,536 rows of three numbers). Everything with rows or files in it is
shuffled by (partition, cell) or by file. No Python runs.

Null source, lang and date count as smallest, a null text has length -1, a null doc_id has no date and comes first in
its cell. Rows that repeat an id are rows of their own; an empty text has length 0 and a text of any length only its
length here. Other columns are not read. An empty table gives an empty layout.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from llm import shared

#: Order of the bits in each digit of z, and of the axes in file_bounds.
ROUND, AXES = ("length", "source", "date", "lang"), ("source", "lang", "length", "date")
DIGITS, SIDE, DAYS = 4, 16, 365
PER_FILE = 500
#: How far a row's query reaches from its own coordinates.
REACH = {"length": 2, "date": 2}


def values(docs: DataFrame) -> DataFrame:
    """doc_id, the four values, and a hash that spreads rows of one id."""
    key = F.col("doc_id").cast("long")
    text = F.col("text").cast("string")
    return docs.select(
        key.alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        F.coalesce(F.octet_length(text), F.lit(-1)).cast("long").alias("length"),
        F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(DAYS)).cast("long").alias("date"),
        F.xxhash64(text).alias("spread"),
    )


def _partition(place: Column) -> Column:
    return F.shiftrightunsigned(place, 33)


def _ordered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows in order of the keys over all partitions, with ``place``: partition number, then place in it."""
    df = df.repartitionByRange(shared.partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    return shared.written(df.withColumn("place", F.monotonically_increasing_id()))


def least_values(rows: DataFrame) -> dict[str, list[tuple[int, object]]]:
    """For each axis, coordinates that occur, ascending, with their least value."""
    n = rows.count()
    each = [
        F.struct(
            F.lit(i).alias("axis"),
            F.col(a).isNotNull().alias("known"),
            (F.col(a) if a in ("source", "lang") else F.lit(None).cast("string")).alias("word"),
            (F.col(a) if a in ("length", "date") else F.lit(None).cast("long")).alias("number"),
        )
        for i, a in enumerate(AXES)
    ]
    counted = rows.select(F.inline(F.array(*each))).groupBy("axis", "known", "word", "number").agg(F.count("*").alias("n"))
    counted = _ordered(counted, "axis", "known", "word", "number").withColumn("part", _partition(F.col("place")))
    whole = counted.groupBy("axis", "part").agg(F.sum("n").alias("whole"))
    earlier = Window.partitionBy("axis").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("axis", "part", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("axis", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    smaller = F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))
    found = (
        counted.join(whole, ["axis", "part"])
        .withColumn("smaller", smaller)
        .withColumn("coordinate", F.expr(f"{SIDE} * smaller div {max(1, n)}L"))
        .groupBy("axis", "coordinate")
        .agg(F.min(F.struct("known", "word", "number")).alias("least"))
    )
    out: dict[str, list[tuple[int, object]]] = {a: [] for a in AXES}
    for r in sorted(found.collect(), key=lambda r: (r.axis, r.coordinate)):  # at most 16 an axis
        axis = AXES[r.axis]
        out[axis].append((r.coordinate, r.least.word if axis in ("source", "lang") else r.least.number))
    return out


def coordinate(value: Column, least: list[tuple[int, object]]) -> Column:
    """The coordinate of a value: that of the last least value it reaches; null is in the first."""
    out = F.lit(0)
    for at, first in least:
        if first is not None:
            out = F.when(value >= F.lit(first), F.lit(at)).otherwise(out)
    return out.cast("long")


def interleaved(of: dict[str, Column]) -> Column:
    bits = [(F.shiftright(of[a], DIGITS - 1 - d).bitwiseAND(F.lit(1)), 4 * (DIGITS - 1 - d) + 3 - i) for d in range(DIGITS) for i, a in enumerate(ROUND)]
    return reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(b.cast("long"), at) for b, at in bits))


def along(z: Column, axis: str, digits: int = DIGITS) -> Column:
    """The leading bits of an axis' coordinate in the first ``digits`` digits of z."""
    i = 3 - ROUND.index(axis)
    return reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(F.shiftright(z, 4 * d + i).bitwiseAND(F.lit(1)), d) for d in range(digits))).cast("long")


def trie(cells: DataFrame) -> list[DataFrame]:
    """Levels from the root's children to the cells: node (its digits so far), n (rows below it), offset (position of the first)."""
    levels = [cells.select(F.col("z").alias("node"), "n")]
    for _ in range(DIGITS - 1):
        levels.append(levels[-1].groupBy(F.shiftright("node", 4).alias("node")).agg(F.sum("n").alias("n")))
    out: list[DataFrame] = []
    for level in reversed(levels):
        lesser = Window.partitionBy("parent").orderBy("node").rowsBetween(Window.unboundedPreceding, -1)
        level = level.withColumn("parent", F.shiftright("node", 4)).withColumn("offset", F.coalesce(F.sum("n").over(lesser), F.lit(0)))
        if out:
            above = out[-1].select(F.col("node").alias("parent"), F.col("offset").alias("start"))
            level = level.join(F.broadcast(above), "parent").withColumn("offset", F.col("offset") + F.col("start"))
        out.append(shared.written(level.select("node", "n", "offset")))
    return out


def matching(levels: list[DataFrame], reach: dict[str, int], per_file: int) -> DataFrame:
    """z, files_matching: files with a row inside the box of each cell, by descent through the nodes that meet it."""
    walk = levels[-1].select(F.col("node").alias("z"), F.lit(0).cast("long").alias("at"))
    wide = [a for a in AXES if reach.get(a)]
    for depth, level in enumerate(levels, 1):
        own = {a: F.shiftright(along(F.col("z"), a), DIGITS - depth).bitwiseAND(F.lit(1)) for a in AXES if a not in wide}
        digits = []
        for bits in itertools.product((0, 1), repeat=len(wide)):  # axes without reach allow one bit only
            of = own | {a: F.lit(b) for a, b in zip(wide, bits, strict=True)}
            digits.append(reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(of[a], 3 - i) for i, a in enumerate(ROUND))))
        walk = walk.select("z", F.explode(F.array(*(F.shiftleft("at", 4) + d for d in digits))).alias("at"))
        for a in wide:
            low, q = F.shiftleft(along(F.col("at"), a, depth), DIGITS - depth), along(F.col("z"), a)
            walk = walk.filter((low <= q + reach[a]) & (low + (1 << (DIGITS - depth)) - 1 >= q - reach[a]))
        walk = walk.join(F.broadcast(level.select(F.col("node").alias("at"), "n", "offset")), "at")
        if depth < DIGITS:
            walk = walk.select("z", "at")
    first, last = _files(per_file)
    order = Window.partitionBy("z").orderBy("offset")
    walk = walk.select("z", "offset", first.alias("first"), last.alias("last"))
    new = F.col("last") - F.col("first") + F.when(F.lag("last").over(order) == F.col("first"), 0).otherwise(1)
    return walk.withColumn("new", new).groupBy("z").agg(F.sum("new").alias("files_matching"))


def _files(per_file: int) -> tuple[Column, Column]:
    """First and last file of a cell with n rows from offset on."""
    return F.expr(f"offset div {per_file}L"), F.expr(f"(offset + n - 1) div {per_file}L")


def touched(cells: DataFrame, reach: dict[str, int], per_file: int) -> DataFrame:
    """z, files_touched: files whose bounds meet the box of each cell, by running sums over the grid of cells."""
    first, last = _files(per_file)
    cells = cells.select(F.col("node").alias("z"), first.alias("first"), last.alias("last"), *(along(F.col("node"), a).alias(a) for a in AXES))
    ends = cells.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("file"), *AXES)
    bounds = ends.groupBy("file").agg(*(f(a).alias(f"{k}_{a}") for a in AXES for k, f in (("low", F.min), ("high", F.max))))
    names = [f"{k}_{a}" for a in AXES for k in ("low", "high")]
    inner = cells.filter("last - first > 1").select((F.col("last") - F.col("first") - 1).alias("files"), *(F.col(a).alias(f"{k}_{a}") for a in AXES for k in ("low", "high")))
    boxes = bounds.select(F.lit(1).cast("long").alias("files"), *names).unionByName(inner).groupBy(*names).agg(F.sum("files").alias("files"))
    corners = []
    for ends_of in itertools.product((0, 1), repeat=len(AXES)):  # a range's lower end adds, and the place after its upper end takes away
        place = [F.greatest(F.col(f"low_{a}") - reach.get(a, 0), F.lit(0)) if e == 0 else F.col(f"high_{a}") + reach.get(a, 0) + 1 for e, a in zip(ends_of, AXES, strict=True)]
        corners.append(F.struct(*(p.alias(a) for p, a in zip(place, AXES, strict=True)), (F.col("files") * (-1) ** sum(ends_of)).alias("change")))
    changes = boxes.select(F.inline(F.array(*corners))).filter(" and ".join(f"{a} < {SIDE}" for a in AXES)).groupBy(*AXES).agg(F.sum("change").alias("files"))
    grid = cells.sparkSession.range(SIDE ** len(AXES)).select(*(F.pmod(F.shiftright("id", 4 * i), F.lit(SIDE)).alias(a) for i, a in enumerate(AXES)))
    grid = grid.join(changes, list(AXES), "left").fillna(0, "files")
    for axis in AXES:
        up_to = Window.partitionBy(*(a for a in AXES if a != axis)).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
        grid = grid.withColumn("files", F.sum("files").over(up_to))
    return cells.join(grid, list(AXES)).select("z", F.col("files").alias("files_touched"))


def layout(docs: DataFrame, per_file: int = PER_FILE, reach: dict[str, int] | None = None) -> DataFrame:
    """doc_id, z, position, file, files_touched, files_matching, file_bounds, and the four coordinates."""
    reach = REACH if reach is None else reach
    rows = shared.written(values(docs))
    least = least_values(rows)
    placed = rows.select("doc_id", "spread", interleaved({a: coordinate(F.col(a), least[a]) for a in AXES}).alias("z"))
    placed = _ordered(placed, "z", "doc_id", "spread").select("doc_id", "z", "place", _partition(F.col("place")).alias("part"))
    runs = shared.written(placed.groupBy("z", "part").agg(F.count("*").alias("n"), F.min("place").alias("least")))
    levels = trie(runs.groupBy("z").agg(F.sum("n").alias("n")))
    cells = levels[-1]
    asked = matching(levels, reach, per_file).join(touched(cells, reach, per_file), "z")
    asked = shared.written(asked.join(cells.select(F.col("node").alias("z"), "offset"), "z"))
    earlier = Window.partitionBy("z").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.col("offset") + F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("least")
    runs = runs.join(asked, "z").select("z", "part", shift.alias("shift"), "files_touched", "files_matching")
    out = placed.join(runs, ["z", "part"]).withColumn("position", F.col("place") + F.col("shift"))
    out = out.select("doc_id", "z", "position", F.expr(f"position div {per_file}L").alias("file"), "files_touched", "files_matching", *(along(F.col("z"), a).alias(f"c_{a}") for a in AXES))
    own = Window.partitionBy("file")
    bounds = F.concat_ws(",", *(f(f"c_{a}").over(own).cast("string") for a in AXES for f in (F.min, F.max)))
    return out.withColumn("file_bounds", bounds)


def write(docs: DataFrame, path: str, per_file: int = PER_FILE) -> None:
    """Writes ``docs`` as Parquet, a folder file=<n> for each file, in order of position.

    Rows are joined to their places by doc_id, so ids must be unique and not null here.
    """
    laid = layout(docs, per_file).select(F.col("doc_id").alias("__id"), "file", "position")
    own = docs.join(laid, F.col("doc_id").cast("long") == F.col("__id")).drop("__id")
    own = own.repartitionByRange(shared.partitions(docs.sparkSession), "file").sortWithinPartitions("file", "position")
    own.drop("position").write.partitionBy("file").parquet(path)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "z", "position", "file", "files_touched", "files_matching", "file_bounds")


def sql(per_file: int = PER_FILE) -> str:
    """The query in DuckDB's SQL."""
    sides = " AND ".join(f"f.low_{a} <= q.{a} + {REACH.get(a, 0)} AND f.high_{a} >= q.{a} - {REACH.get(a, 0)}" for a in AXES)
    inside = " AND ".join(f"f.{a} BETWEEN q.{a} - {REACH.get(a, 0)} AND q.{a} + {REACH.get(a, 0)}" for a in AXES)
    bits = " + ".join(f"((({a} >> {3 - d}) & 1) << {4 * (3 - d) + 3 - i})" for d in range(DIGITS) for i, a in enumerate(ROUND))
    return f"""
WITH bytes AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_concat([i], range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END) AS v
    FROM range(256) r(i))
), named AS (
  SELECT doc_id, source, lang, coalesce(strlen(text), -1) AS length,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % {DAYS} AS date
  FROM documents, bytes
), ranked AS (
  SELECT doc_id, {", ".join(f"{SIDE} * (rank() OVER (ORDER BY {a} NULLS FIRST) - 1) // count(*) OVER () AS {a}" for a in AXES)} FROM named
), laid AS (
  SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM (SELECT *, {bits} AS z FROM ranked)
), placed AS (
  SELECT *, position // {per_file} AS file FROM laid
), files AS (
  SELECT file, {", ".join(f"min({a}) AS low_{a}, max({a}) AS high_{a}" for a in AXES)} FROM placed GROUP BY file
), cells AS (
  SELECT DISTINCT z, file, {", ".join(AXES)} FROM placed
), asked AS (
  SELECT DISTINCT z, {", ".join(AXES)} FROM placed
), touch AS (
  SELECT q.z, count(*) AS files_touched FROM asked q JOIN files f ON {sides} GROUP BY q.z
), matched AS (
  SELECT q.z, count(DISTINCT f.file) AS files_matching FROM asked q JOIN cells f ON {inside} GROUP BY q.z
)
SELECT doc_id, z::BIGINT AS z, position::BIGINT AS position, file::BIGINT AS file, files_touched, files_matching,
  concat_ws(',', {", ".join(f"low_{a}, high_{a}" for a in AXES)}) AS file_bounds
FROM placed JOIN files USING (file) JOIN touch USING (z) JOIN matched USING (z)
"""
