"""Queries over masks and tiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import index, metadata, runs, summed, tiles, tiling
from tessera.sources import roles

TILE, STRIDE, TOLERANCE = 10, 8, 0.7


def _tiles(spark, sf_dir):
    return tiling.grid_tiles(roles.mask(spark, sf_dir), TILE, STRIDE, TOLERANCE)


def grid_tile_stats(spark, sf_dir):
    stats = tiling.grid_stats(roles.mask(spark, sf_dir), TILE, STRIDE, TOLERANCE)
    exact = ["tissue_mask_frac", "coverage_ratio", "overlap_ratio"]
    return stats.withColumns({c: F.round(c, 6) for c in exact})


def _extents(spark, sf_dir):
    """Shapes of all suppliers' masks, larger than their pixels' extent, and of as many that are empty."""
    ids = roles.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tissue_id"))
    every = ids.union(ids.select(F.col("tissue_id") + 1_000_000))
    return every.select("tissue_id", (F.col("tissue_id") % 7 + 50).cast("int").alias("h"), F.lit(40).alias("w"))


def grid_stats_of_shapes(spark, sf_dir):
    stats = tiling.grid_stats(roles.mask(spark, sf_dir), TILE, None, TOLERANCE, _extents(spark, sf_dir))
    return stats.withColumns({c: F.round(c, 6) for c in ("tissue_mask_frac", "coverage_ratio", "overlap_ratio")})


def tiling_summary(spark, sf_dir):
    s = tiling.run_summary(tiling.grid_stats(roles.mask(spark, sf_dir), TILE, STRIDE, TOLERANCE))
    return s.select("tissues", "tiles", F.round("mean_coverage", 6).alias("mean_coverage"), F.round("std_coverage", 6).alias("std_coverage"))


def tile_valid_ratio(spark, sf_dir):
    r = tiles.valid_ratio(roles.mask(spark, sf_dir), _tiles(spark, sf_dir), TILE)
    return r.select("tissue_id", "tile_id", F.round("valid_ratio", 6).alias("valid_ratio"), "grade")


def valid_ratio_hist(spark, sf_dir):
    return tiles.ratio_histogram(tiles.valid_ratio(roles.mask(spark, sf_dir), _tiles(spark, sf_dir), TILE))


def valid_ratio_mean(spark, sf_dir):
    r = tiles.ratio_summary(tiles.valid_ratio(roles.mask(spark, sf_dir), _tiles(spark, sf_dir), TILE))
    return r.select("tiles", F.round("mean_ratio", 6).alias("mean_ratio"))


def in_bounds_tiles(spark, sf_dir):
    mask = roles.mask(spark, sf_dir)
    return tiles.in_bounds(_tiles(spark, sf_dir), tiling.sizes(mask), TILE).select("tissue_id", "tile_id")


def integral_image(spark, sf_dir):
    return tiling.integral_image(roles.mask(spark, sf_dir))


def rect_sums(spark, sf_dir):
    """Pixels of the rectangle from (8, 8) to (23, 23) of each tissue, from four corners."""
    total = tiling.integral_image(roles.mask(spark, sf_dir)).where("y in (7, 23) and x in (7, 23)")
    sign = F.when((F.col("y") == 7) == (F.col("x") == 7), 1).otherwise(-1)
    return total.groupBy("tissue_id").agg(F.sum(sign * F.col("total")).alias("pixels"))


def integral_image_blocks(spark, sf_dir):
    return summed.integral_image(roles.mask(spark, sf_dir), block=8)


def rect_sums_blocks(spark, sf_dir):
    """Pixels of rectangles that parts lay over the tissues of their suppliers, some beyond the borders."""
    mask = roles.mask(spark, sf_dir)
    extents = tiling.sizes(mask)
    laid = roles.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("tissue_id"), F.col("l_partkey").alias("rect_id")).distinct()
    y0, x0 = (F.col("rect_id") % 47 - 3).cast("int"), (F.col("rect_id") % 29 - 2).cast("int")
    laid = laid.withColumns({"y0": y0, "x0": x0, "y1": (y0 + 1 + F.col("rect_id") % 13).cast("int"), "x1": (x0 + 1 + F.col("rect_id") % 17).cast("int")})
    found = summed.rect_sums(laid, summed.summed_areas(mask, extents, 8), extents, 8)
    return found.select("tissue_id", "rect_id", "pixels")


def _runs(spark, sf_dir):
    return runs.of_pixels(roles.mask(spark, sf_dir))


def mask_runs(spark, sf_dir):
    return _runs(spark, sf_dir)


def grid_tiles_runs(spark, sf_dir):
    return runs.grid_tiles(_runs(spark, sf_dir), TILE, STRIDE, TOLERANCE)


def tile_valid_ratio_runs(spark, sf_dir):
    r = runs.valid_ratio(_runs(spark, sf_dir), _tiles(spark, sf_dir), TILE)
    return r.select("tissue_id", "tile_id", F.round("valid_ratio", 6).alias("valid_ratio"), "grade")


def masked_pixels_runs(spark, sf_dir):
    """Items whose place, moved by their number, is tissue of their supplier."""
    items = roles.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("tissue_id"), (F.col("l_quantity").cast("int") - 1).alias("y"), (F.dayofmonth("l_shipdate") - 1 + F.col("l_linenumber") % 3).alias("x"), "l_orderkey", "l_linenumber"
    )
    return runs.masked(items, _runs(spark, sf_dir), 4).select("l_orderkey", "l_linenumber")


def cohort_index_in_order(spark, sf_dir):
    """Tiles numbered by cohort in an order of its own, then tissue and tile."""
    names = roles.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tissue_id"), (25 - F.col("s_nationkey")).alias("place"), F.concat(F.lit("cohort_"), F.col("s_nationkey").cast("string")).alias("dataset_name"))
    made = index.numbered(_tiles(spark, sf_dir).join(names, "tissue_id"), ["place", "tissue_id"], ["tile_id"])
    return made.select("global_id", "dataset_name", "tissue_id", "tile_id", "row", "col")


def candidate_starts(spark, sf_dir):
    starts = tiling.candidate_starts(F.col("p_size"), 7, 4)
    return roles.table(spark, sf_dir, "part").select("p_partkey", F.array_join(starts, ",").alias("starts"))


def point_in_tile(spark, sf_dir):
    points = roles.mask(spark, sf_dir).withColumn("point_id", F.concat_ws("-", "tissue_id", "y", "x"))
    return tiles.hit(points, _tiles(spark, sf_dir), TILE)


def _valued(spark, sf_dir):
    return roles.mask(spark, sf_dir).withColumn("value", (F.col("y") * 31 + F.col("x")).cast("double"))


def tile_crop_padded(spark, sf_dir):
    return tiles.crop(_valued(spark, sf_dir), _tiles(spark, sf_dir), TILE).select("tissue_id", "tile_id", "dy", "dx", "value")


def tile_crop_default(spark, sf_dir):
    return tiles.crop(_valued(spark, sf_dir), _tiles(spark, sf_dir), TILE, padded=False)


def greedy_tiles(spark, sf_dir):
    return tiling.greedy_tiles(roles.mask(spark, sf_dir), TILE, 5, 0.9, 0.9, 0.1).select("tissue_id", "tile_id", "row", "col", "valid", "gain")


def greedy_tile_stats(spark, sf_dir):
    rows = tiling.greedy_tiles(roles.mask(spark, sf_dir), TILE, 5, 0.9, 0.9, 0.1)
    return rows.groupBy("tissue_id").agg(
        F.count("tile_id").alias("num_tiles"), F.first("covered").alias("covered"), F.first("total").alias("total"), F.first("stop_reason").alias("stop_reason")
    )


def tile_index_global_id(spark, sf_dir):
    names = roles.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("tissue_id"), F.concat(F.lit("cohort_"), F.col("s_nationkey").cast("string")).alias("dataset_name"))
    coords = _tiles(spark, sf_dir).join(names, "tissue_id")
    return metadata.tile_index(coords).select("global_tile_id", "dataset_name", "tissue_id", "tile_id", "row", "col")


def tile_by_ordinal(spark, sf_dir):
    return tiles.by_ordinal(_tiles(spark, sf_dir), 3).select("tissue_id", "tile_id", "row", "col")


def tile_lists(spark, sf_dir):
    lists = tiles.lists(_tiles(spark, sf_dir))
    text = F.transform("tiles", lambda t: F.concat_ws(":", t["tile_id"], t["row"], t["col"]))
    return lists.select("tissue_id", F.array_join(text, " ").alias("tiles"))


def sample_tiles_hash(spark, sf_dir):
    return metadata.sample(_tiles(spark, sf_dir), 50, 7, ["tissue_id", "tile_id"]).select("tissue_id", "tile_id")


def random_tile_offsets(spark, sf_dir):
    return tiles.random_tiles(tiling.sizes(roles.mask(spark, sf_dir)), TILE, 3)


def tile_draws(spark, sf_dir):
    index = metadata.tile_index(_tiles(spark, sf_dir).withColumn("dataset_name", F.lit("all")))
    return metadata.sample_with_replacement(index, 60, 5, "global_tile_id").select("draw", "global_tile_id", "tissue_id", "tile_id")


QUERIES = {
    "grid_stats_of_shapes": grid_stats_of_shapes,
    "valid_ratio_mean": valid_ratio_mean,
    "tile_draws": tile_draws,
    "grid_tiles": _tiles,
    "grid_tile_stats": grid_tile_stats,
    "tiling_summary": tiling_summary,
    "tile_valid_ratio": tile_valid_ratio,
    "valid_ratio_hist": valid_ratio_hist,
    "in_bounds_tiles": in_bounds_tiles,
    "integral_image": integral_image,
    "rect_sums": rect_sums,
    "integral_image_blocks": integral_image_blocks,
    "rect_sums_blocks": rect_sums_blocks,
    "mask_runs": mask_runs,
    "grid_tiles_runs": grid_tiles_runs,
    "tile_valid_ratio_runs": tile_valid_ratio_runs,
    "masked_pixels_runs": masked_pixels_runs,
    "cohort_index_in_order": cohort_index_in_order,
    "candidate_starts": candidate_starts,
    "point_in_tile": point_in_tile,
    "tile_crop_padded": tile_crop_padded,
    "tile_crop_default": tile_crop_default,
    "greedy_tiles": greedy_tiles,
    "greedy_tile_stats": greedy_tile_stats,
    "tile_index_global_id": tile_index_global_id,
    "tile_by_ordinal": tile_by_ordinal,
    "tile_lists": tile_lists,
    "sample_tiles_hash": sample_tiles_hash,
    "random_tile_offsets": random_tile_offsets,
}

_GRID = """, size AS (SELECT tissue_id, max(y) + 1 AS h, max(x) + 1 AS w, count(*) AS total FROM mask GROUP BY tissue_id),
    starts AS (SELECT i * 8 AS s FROM range(0, 8) r(i)),
    counts AS (SELECT m.tissue_id, a.s AS "row", b.s AS "col", count(*) AS valid FROM mask m JOIN starts a ON m.y BETWEEN a.s AND a.s + 9 JOIN starts b ON m.x BETWEEN b.s AND b.s + 9 GROUP BY ALL),
    tiles AS (SELECT tissue_id, CAST(row_number() OVER (PARTITION BY tissue_id ORDER BY "row", "col") - 1 AS INT) AS tile_id, CAST("row" AS INT) AS "row", CAST("col" AS INT) AS "col", CAST(valid AS INT) AS valid
              FROM counts WHERE valid / 100.0 >= 1 - CAST(0.7 AS DOUBLE))"""
_HELD = 'm.tissue_id = t.tissue_id AND m.y BETWEEN t."row" AND t."row" + 9 AND m.x BETWEEN t."col" AND t."col" + 9'
_STATS = f""", covered AS (SELECT tissue_id, count(*) AS covered FROM (SELECT DISTINCT m.tissue_id, m.y, m.x FROM mask m JOIN tiles t ON {_HELD}) GROUP BY tissue_id),
    n AS (SELECT tissue_id, count(*) AS num_tiles FROM tiles GROUP BY tissue_id),
    st AS (SELECT tissue_id, h, w, total, coalesce(num_tiles, 0) AS num_tiles, coalesce(covered, 0) AS covered FROM size LEFT JOIN n USING (tissue_id) LEFT JOIN covered USING (tissue_id))"""
_RATIO = f""", ratio AS (SELECT t.tissue_id, t.tile_id, count(m.y) / 100.0 AS valid_ratio FROM tiles t LEFT JOIN mask m ON {_HELD} GROUP BY ALL)"""
_INTEGRAL = """, cells AS (SELECT tissue_id, CAST(i AS INT) AS y, CAST(j AS INT) AS x FROM size, range(0, 50) a(i), range(0, 31) b(j) WHERE i < h AND j < w),
    filled AS (SELECT c.*, CASE WHEN m.y IS NULL THEN 0 ELSE 1 END AS one FROM cells c LEFT JOIN mask m USING (tissue_id, y, x)),
    along AS (SELECT *, sum(one) OVER (PARTITION BY tissue_id, y ORDER BY x) AS s FROM filled),
    integral AS (SELECT tissue_id, y, x, CAST(sum(s) OVER (PARTITION BY tissue_id, x ORDER BY y) AS BIGINT) AS total FROM along)"""


#: The greedy cover step by step: each row of `steps` holds a tissue's tiles so far, and why it stopped.
_GREEDY = """, ys AS (SELECT DISTINCT tissue_id, s AS r FROM (SELECT tissue_id, unnest(range(0, greatest(h - 10, 0) + 1, 5)) AS s FROM size UNION ALL SELECT tissue_id, greatest(h - 10, 0) FROM size)),
    xs AS (SELECT DISTINCT tissue_id, s AS c FROM (SELECT tissue_id, unnest(range(0, greatest(w - 10, 0) + 1, 5)) AS s FROM size UNION ALL SELECT tissue_id, greatest(w - 10, 0) FROM size)),
    held AS (SELECT m.tissue_id, r, c, m.y, m.x FROM ys JOIN xs USING (tissue_id) JOIN mask m ON m.tissue_id = ys.tissue_id AND m.y BETWEEN r AND r + 9 AND m.x BETWEEN c AND c + 9),
    able AS (SELECT tissue_id, r, c, count(*) AS valid FROM held GROUP BY ALL HAVING count(*) / 100.0 >= 1 - CAST(0.9 AS DOUBLE)),
    px AS (SELECT held.*, valid FROM held JOIN able USING (tissue_id, r, c)),
    steps AS (
        SELECT tissue_id, 0 AS n, CAST([] AS STRUCT(r BIGINT, c BIGINT, valid BIGINT, gain BIGINT)[]) AS tiles, CAST(0 AS BIGINT) AS covered, total, CAST(NULL AS VARCHAR) AS stop FROM size
        UNION ALL
        SELECT tissue_id, n + 1, CASE WHEN why IS NULL THEN list_append(tiles, best) ELSE tiles END, CASE WHEN why IS NULL THEN covered + best.gain ELSE covered END, total, why
        FROM (SELECT *, CASE WHEN best.gain <= 0 THEN 'no_gain' WHEN covered / total >= 0.9 AND best.gain < 10 THEN 'adaptive_stop' END AS why
              FROM (SELECT tissue_id, n, tiles, covered, total, max_by({'r': r, 'c': c, 'valid': valid, 'gain': gain}, gain * 1000000 - r * 1000 - c) AS best
                    FROM (SELECT s.tissue_id, s.n, s.tiles, s.covered, s.total, CAST(p.r AS BIGINT) AS r, CAST(p.c AS BIGINT) AS c, any_value(p.valid) AS valid,
                                 count(*) FILTER (len(list_filter(s.tiles, lambda t: p.y BETWEEN t.r AND t.r + 9 AND p.x BETWEEN t.c AND t.c + 9)) = 0) AS gain
                          FROM steps s JOIN px p ON p.tissue_id = s.tissue_id WHERE s.stop IS NULL AND len(list_filter(s.tiles, lambda t: t.r = p.r AND t.c = p.c)) = 0
                          GROUP BY s.tissue_id, s.n, s.tiles, s.covered, s.total, p.r, p.c)
                    GROUP BY tissue_id, n, tiles, covered, total))),
    greedy AS (SELECT tissue_id, tiles, covered, total, coalesce(stop, 'candidates_exhausted') AS stop_reason FROM steps QUALIFY row_number() OVER (PARTITION BY tissue_id ORDER BY n DESC) = 1)"""


def drawn_sql(seed: int, *keys: str) -> str:
    """The number that samplers draw for the keys."""
    text = " || '|' || ".join([f"'{seed}'", *(f"CAST({k} AS VARCHAR)" for k in keys)])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT)"


def sql(body: str) -> str:
    return f"WITH {roles.VIEWS_SQL}{_GRID}{body}"


def _extent(n: str) -> str:
    return f"CAST(CASE WHEN {n} <= 10 THEN 10 ELSE ceil(({n} - 10) / 8.0) * 8 + 10 END AS INT)"


ORACLES = {
    "grid_tiles": sql(" SELECT * FROM tiles"),
    "grid_tile_stats": sql(_STATS + f""" SELECT tissue_id, h AS mask_height, w AS mask_width, round(total / (h * w), 6) AS tissue_mask_frac, num_tiles, round(covered / total, 6) AS coverage_ratio,
        covered AS covered_valid_pixels, total AS total_valid_pixels, num_tiles AS candidate_count, num_tiles * 100 AS total_tile_area, greatest(0, num_tiles * 100 - covered) AS overlap_pixels,
        round(CASE WHEN num_tiles = 0 THEN 0.0 ELSE greatest(0, num_tiles * 100 - covered) / (num_tiles * 100) END, 6) AS overlap_ratio, 'fixed_grid_complete' AS stop_reason,
        CAST((({_extent('h')} - 10) / 8 + 1) * (({_extent('w')} - 10) / 8 + 1) AS INT) AS grid_candidate_count, {_extent('h')} AS padded_height, {_extent('w')} AS padded_width FROM st"""),
    "grid_stats_of_shapes": f"""WITH {roles.VIEWS_SQL}, shape AS (SELECT s_suppkey + d AS tissue_id, CAST((s_suppkey + d) % 7 + 50 AS INT) AS h, 40 AS w FROM supplier, (VALUES (0), (1000000)) v(d)),
        c AS (SELECT tissue_id, y // 10 AS r, x // 10 AS k, count(*) AS valid FROM mask GROUP BY ALL),
        kept AS (SELECT tissue_id, count(*) AS num_tiles, CAST(sum(valid) AS BIGINT) AS covered FROM c WHERE valid / 100.0 >= 1 - CAST(0.7 AS DOUBLE) GROUP BY tissue_id),
        total AS (SELECT tissue_id, count(*) AS total FROM mask GROUP BY tissue_id),
        st AS (SELECT tissue_id, h, w, coalesce(total, 0) AS total, coalesce(num_tiles, 0) AS num_tiles, coalesce(covered, 0) AS covered, CAST(ceil(h / 10.0) * 10 AS INT) AS ph FROM shape LEFT JOIN kept USING (tissue_id) LEFT JOIN total USING (tissue_id))
        SELECT tissue_id, h AS mask_height, w AS mask_width, round(total / (h * w), 6) AS tissue_mask_frac, num_tiles, round(CASE WHEN total = 0 THEN 1.0 ELSE covered / total END, 6) AS coverage_ratio,
        covered AS covered_valid_pixels, total AS total_valid_pixels, num_tiles AS candidate_count, num_tiles * 100 AS total_tile_area, num_tiles * 100 - covered AS overlap_pixels,
        round(CASE WHEN num_tiles = 0 THEN 0.0 ELSE (num_tiles * 100 - covered) / (num_tiles * 100) END, 6) AS overlap_ratio,
        CASE WHEN total = 0 THEN 'empty_mask' ELSE 'fixed_grid_complete' END AS stop_reason, CAST(ph / 10 * 4 AS INT) AS grid_candidate_count, ph AS padded_height, 40 AS padded_width FROM st""",
    "valid_ratio_mean": sql(_RATIO + " SELECT count(*) AS tiles, round(avg(CAST(valid_ratio AS DOUBLE)), 6) AS mean_ratio FROM ratio"),
    "sample_tiles_hash": sql(f" SELECT tissue_id, tile_id FROM tiles ORDER BY {drawn_sql(7, 'tissue_id', 'tile_id')}, tissue_id, tile_id LIMIT 50"),
    "random_tile_offsets": sql(f""" SELECT tissue_id, CAST({drawn_sql(3, 'tissue_id', "'row'")} % greatest(h - 9, 1) AS INT) AS "row", CAST({drawn_sql(3, 'tissue_id', "'col'")} % greatest(w - 9, 1) AS INT) AS "col" FROM size"""),
    "tile_draws": sql(f""", numbered AS (SELECT row_number() OVER (ORDER BY tissue_id, tile_id) - 1 AS global_tile_id, tissue_id, tile_id FROM tiles),
        draws AS (SELECT d AS draw, {drawn_sql(5, 'd')} % (SELECT count(*) FROM tiles) AS global_tile_id FROM range(60) r(d))
        SELECT draw, global_tile_id, tissue_id, tile_id FROM draws JOIN numbered USING (global_tile_id)"""),
    "tiling_summary": sql(_STATS + " SELECT count(*) AS tissues, CAST(sum(num_tiles) AS BIGINT) AS tiles, round(avg(covered / total), 6) AS mean_coverage, round(stddev_pop(covered / total), 6) AS std_coverage FROM st"),
    "tile_valid_ratio": sql(_RATIO + " SELECT tissue_id, tile_id, round(CAST(valid_ratio AS DOUBLE), 6) AS valid_ratio, CASE WHEN valid_ratio >= 0.5 THEN 'good' WHEN valid_ratio >= 0.2 THEN 'warn' ELSE 'none' END AS grade FROM ratio"),
    "valid_ratio_hist": sql(_RATIO + " SELECT CAST(least(19, floor(CAST(valid_ratio AS DOUBLE) * 20)) AS INT) AS bin, count(*) AS tiles FROM ratio GROUP BY 1"),
    "in_bounds_tiles": sql(' SELECT tissue_id, tile_id FROM tiles JOIN size USING (tissue_id) WHERE "row" + 10 <= h AND "col" + 10 <= w'),
    "integral_image": sql(_INTEGRAL + " SELECT * FROM integral"),
    "rect_sums": sql(_INTEGRAL + " SELECT tissue_id, CAST(sum(CASE WHEN (y = 7) = (x = 7) THEN total ELSE -total END) AS BIGINT) AS pixels FROM integral WHERE y IN (7, 23) AND x IN (7, 23) GROUP BY tissue_id"),
    "candidate_starts": """SELECT p_partkey, CASE WHEN p_size <= 7 THEN '0' ELSE (SELECT string_agg(CAST(s AS VARCHAR), ',' ORDER BY s) FROM
        (SELECT DISTINCT s FROM (SELECT unnest(range(0, CAST(p_size AS INT) - 6, 4)) AS s UNION ALL SELECT p_size - 7))) END AS starts FROM part""",
    "point_in_tile": sql(f" SELECT concat_ws('-', m.tissue_id, m.y, m.x) AS point_id, m.tissue_id, min(t.tile_id) AS tile_id FROM mask m JOIN tiles t ON {_HELD} GROUP BY m.tissue_id, m.y, m.x"),
    "tile_crop_padded": sql(""" SELECT t.tissue_id, t.tile_id, CAST(i AS INT) AS dy, CAST(j AS INT) AS dx, CASE WHEN m.y IS NULL THEN 0.0 ELSE CAST(m.y * 31 + m.x AS DOUBLE) END AS value
        FROM tiles t CROSS JOIN range(0, 10) a(i) CROSS JOIN range(0, 10) b(j) LEFT JOIN mask m ON m.tissue_id = t.tissue_id AND m.y = t."row" + i AND m.x = t."col" + j"""),
    "tile_crop_default": sql(f' SELECT t.tissue_id, t.tile_id, m.y - t."row" AS dy, m.x - t."col" AS dx, CAST(m.y * 31 + m.x AS DOUBLE) AS value FROM mask m JOIN tiles t ON {_HELD}'),
    "greedy_tiles": sql(_GREEDY + """, placed AS (SELECT tissue_id, CASE WHEN len(tiles) = 0 THEN [NULL] ELSE range(0, len(tiles)) END AS ids, tiles FROM greedy),
        each AS (SELECT tissue_id, unnest(ids) AS i, tiles FROM placed)
        SELECT tissue_id, CAST(i AS INT) AS tile_id, CAST(tiles[i + 1].r AS INT) AS "row", CAST(tiles[i + 1].c AS INT) AS "col", CAST(tiles[i + 1].valid AS INT) AS valid, CAST(tiles[i + 1].gain AS INT) AS gain FROM each""").replace("WITH ", "WITH RECURSIVE ", 1),
    "greedy_tile_stats": sql(_GREEDY + " SELECT tissue_id, len(tiles) AS num_tiles, covered, total, stop_reason FROM greedy").replace("WITH ", "WITH RECURSIVE ", 1),
    "tile_index_global_id": sql(""", named AS (SELECT 'cohort_' || s_nationkey AS dataset_name, t.* FROM tiles t JOIN supplier ON s_suppkey = tissue_id)
        SELECT row_number() OVER (ORDER BY dataset_name, tissue_id, tile_id) - 1 AS global_tile_id, dataset_name, tissue_id, tile_id, "row", "col" FROM named"""),
    "tile_by_ordinal": sql(' SELECT tissue_id, tile_id, "row", "col" FROM tiles WHERE tile_id = 3'),
    "tile_lists": sql(""" SELECT tissue_id, string_agg(tile_id || ':' || "row" || ':' || "col", ' ' ORDER BY tile_id) AS tiles FROM tiles GROUP BY tissue_id"""),
}
ORACLES |= {
    "integral_image_blocks": ORACLES["integral_image"],
    "grid_tiles_runs": ORACLES["grid_tiles"],
    "tile_valid_ratio_runs": ORACLES["tile_valid_ratio"],
    "rect_sums_blocks": sql(""", laid AS (SELECT DISTINCT l_suppkey AS tissue_id, l_partkey AS rect_id FROM lineitem),
        rects AS (SELECT *, rect_id % 47 - 3 AS y0, rect_id % 29 - 2 AS x0, rect_id % 47 - 2 + rect_id % 13 AS y1, rect_id % 29 - 1 + rect_id % 17 AS x1 FROM laid)
        SELECT r.tissue_id, r.rect_id, count(m.y) AS pixels FROM rects r LEFT JOIN mask m ON m.tissue_id = r.tissue_id AND m.y >= y0 AND m.y < y1 AND m.x >= x0 AND m.x < x1 GROUP BY ALL"""),
    "mask_runs": sql(" SELECT tissue_id, y, CAST(min(x) AS INT) AS x0, CAST(max(x) + 1 AS INT) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY tissue_id, y ORDER BY x) AS k FROM mask) GROUP BY tissue_id, y, k"),
    "masked_pixels_runs": sql(""" SELECT l_orderkey, l_linenumber FROM lineitem JOIN mask m ON m.tissue_id = l_suppkey AND m.y = CAST(l_quantity AS INT) - 1
        AND m.x = CAST(day(l_shipdate) AS INT) - 1 + l_linenumber % 3"""),
    "cohort_index_in_order": sql(""", named AS (SELECT 'cohort_' || s_nationkey AS dataset_name, s_nationkey, t.* FROM tiles t JOIN supplier ON s_suppkey = tissue_id)
        SELECT row_number() OVER (ORDER BY s_nationkey DESC, tissue_id, tile_id) - 1 AS global_id, dataset_name, tissue_id, tile_id, "row", "col" FROM named"""),
}
