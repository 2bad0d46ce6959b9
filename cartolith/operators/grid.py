"""White space of the technology by problem map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), part / whole))).otherwise(F.lit(0.0))


def clamp(name: str) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col(name), F.lit(0.0))))


def level(value: Column) -> Column:
    return F.when(value >= 0.67, "高").when(value >= 0.40, "中").otherwise("低")


def dense(cells: DataFrame) -> DataFrame:
    """(x, y, count) of every cell of the axes (positions from 0 in the order of the ids), with row and column totals.

    The axes are cluster ids, of which a map has about the square root of its documents.
    """
    xs = cells.select("tech").distinct().withColumn("x", F.row_number().over(Window.orderBy("tech")) - 1)
    ys = cells.select("problem").distinct().withColumn("y", F.row_number().over(Window.orderBy("problem")) - 1)
    # the product of two axes, which is the map itself
    whole = xs.withColumn("_k", F.lit(0)).join(ys.withColumn("_k", F.lit(0)), "_k").drop("_k")
    filled = whole.join(cells.select("tech", "problem", "count"), ["tech", "problem"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    return filled.withColumn("tech_total", F.sum("count").over(Window.partitionBy("tech"))).withColumn("problem_total", F.sum("count").over(Window.partitionBy("problem")))


def neighbours(grid: DataFrame) -> DataFrame:
    """Occupied cells among the up to four neighbours of each cell, and how many neighbours it has."""
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    posted = grid.select("count", F.explode(steps).alias("s"), "x", "y").select((F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"), "count")
    return posted.groupBy("x", "y").agg(F.count_if(F.col("count") > 0).alias("occupied_neighbours"), F.count("*").alias("neighbours"))


def whitespace_scores(cells: DataFrame, fits: DataFrame | None = None) -> DataFrame:
    """Scores of every empty cell.

    demand: the problem's total against the greatest; capability: the technology's; adjacency: occupied
    neighbours against all; strategic fit: the mean of the two axes' fits (tech_fit, problem_fit in `fits`; 0 if unknown).
    """
    grid = dense(cells)
    grid = grid.withColumns({"tech_max": F.max("tech_total").over(Window.partitionBy(F.lit(0))), "problem_max": F.max("problem_total").over(Window.partitionBy(F.lit(0)))})
    near = grid.join(neighbours(grid), ["x", "y"])
    if fits is not None:
        near = near.join(fits, ["tech", "problem"], "left")
    else:
        near = near.withColumns({"tech_fit": F.lit(None).cast("double"), "problem_fit": F.lit(None).cast("double")})
    d = ratio(F.col("problem_total"), F.col("problem_max"))
    c = ratio(F.col("tech_total"), F.col("tech_max"))
    a = ratio(F.col("occupied_neighbours"), F.col("neighbours"))
    s = (clamp("tech_fit") + clamp("problem_fit")) / 2
    empty = near.where("count = 0").select("tech", "problem", "x", "y", d.alias("demand"), c.alias("capability"), a.alias("adjacency"), s.alias("strategic_fit"), "occupied_neighbours")
    return empty.withColumns({
        "opportunity": 0.3 * F.col("demand") + 0.25 * F.col("capability") + 0.25 * F.col("strategic_fit") + 0.2 * F.col("adjacency"),
        "bridge": 0.4 * F.col("capability") + 0.3 * F.col("demand") + 0.3 * F.col("adjacency"),
    })


def whitespace_blocks(cells: DataFrame) -> DataFrame:
    """(tech, problem, block, block_size, pattern) of the empty cells: 4-connected blocks of the map.

    The map is the product of two axes of cluster ids, so it fits one task by construction and is labelled there.
    """
    grid = dense(cells)

    def label(pdf):
        import pandas as pd

        empty = {(x, y) for x, y, n in zip(pdf["x"], pdf["y"], pdf["count"]) if n == 0}
        width, height = pdf["x"].max() + 1, pdf["y"].max() + 1
        block: dict[tuple[int, int], int] = {}
        size: dict[int, int] = {}
        for start in sorted(empty):
            if start in block:
                continue
            name = start[0] * height + start[1]
            reached, todo = {start}, [start]
            while todo:
                x, y = todo.pop()
                for p in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                    if p in empty and p not in reached:
                        reached.add(p)
                        todo.append(p)
            block.update(dict.fromkeys(reached, name))
            size[name] = len(reached)
        large = max(4, -(-width * height // 5))
        rows = []
        for t, p, x, y in zip(pdf["tech"], pdf["problem"], pdf["x"], pdf["y"]):
            if (x, y) in block:
                n = size[block[x, y]]
                rows.append((t, p, block[x, y], n, "large" if n >= large else "contiguous" if n > 1 else "isolated"))
        return pd.DataFrame(rows, columns=["tech", "problem", "block", "block_size", "pattern"])

    return grid.groupBy(F.lit(0).alias("_all")).applyInPandas(label, "tech string, problem string, block long, block_size long, pattern string")


def relative_proximity(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Adds relative_proximity: value scaled to 0 to 1 over the group, 1.0 if all are alike."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    low, spread = F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w)
    return rows.withColumn("relative_proximity", F.when(spread <= 1e-12, F.lit(1.0)).otherwise(F.bround((F.col(value) - low) / spread, 6)))
