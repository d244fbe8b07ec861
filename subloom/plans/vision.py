"""Queries on images: an embedding's 64 values are 8 rows of 8 cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, pixels
from ..operators import candidates as C
from . import tables as tab

CELL = (24, 12)


def enlarged(cells: Column, size: tuple[int, int] = CELL) -> Column:
    """Bytes of an image of 8 by 8 gray cells of ``size`` (width, height) pixels."""
    line = lambda r: F.array_join(F.transform(F.slice(cells, r * 8 + 1, 8), lambda x: F.repeat(F.lpad(F.hex(x), 2, "0"), F.lit(size[0]))), "")
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.repeat(line(r), F.lit(size[1]))), ""))


def images(spark: SparkSession, d: str, size: tuple[int, int] = CELL) -> DataFrame:
    """Embeddings as crops; some are brighter than others, so that each rule decides for some."""
    e = tab.spread(tab.table(spark, d, "embeddings").where("size(embedding) = 64"))
    value = lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(128 + 512 * x.cast("double") + (F.col("vec_id") % 4) * 16))).cast("int")
    cells = F.transform("embedding", value)
    return e.select(F.col("label").cast("string").alias("video_id"), "vec_id", F.col("vec_id").cast("double").alias("time"), enlarged(cells, size).alias("pixels"), F.lit(8 * size[0]).alias("width"), F.lit(8 * size[1]).alias("height"))


def mask_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of each mask of eight by eight, closed and opened by small windows."""
    e = tab.spread(tab.table(spark, d, "embeddings").where("size(embedding) = 64"))
    m = arrays.mask(F.col("embedding"), 0.05)
    df = e.select("vec_id", pixels.components_of(m, F.lit(8), (3, 1), (2, 1)).alias("c"))
    return df.select("vec_id", F.posexplode_outer("c").alias("at", "c")).select("vec_id", (F.col("at") + 1).alias("component"), *[F.col(f"c.{k}").cast("bigint").alias(k) for k in ("x", "y", "w", "h", "area")])


def white_text_frames(spark: SparkSession, d: str) -> DataFrame:
    """What pixels tell of each crop: components, letters, text box, decision, crop and compact mask."""
    df = C.with_text(images(spark, d))
    n = lambda c: c.cast("bigint")
    box = [n(F.col(f"text_box.{k}")).alias(k) for k in ("x1", "y1", "x2", "y2", "area")]
    crop = [n(F.col(f"crop.{k}")).alias(f"crop_{k}") for k in ("x1", "y1", "x2", "y2")]
    on = n(F.size(F.filter("mask", lambda x: x)))
    return df.select("vec_id", F.round("bright", 6).alias("bright"), n(F.col("n_components")).alias("components"), n(F.size("boxes")).alias("letters"), *box, "detected", *crop, on.alias("mask_on"))


MODES = ("grayscale", "contrast", "threshold", "adaptive", "simple", "subtitle", "none")


def preprocess_modes(spark: SparkSession, d: str) -> DataFrame:
    """Each crop of 8 by 8 as each mode prepares it: size and digest of all its bytes."""
    each = images(spark, d, (1, 1)).select("vec_id", "pixels", "width", "height", F.explode(F.array(*map(F.lit, MODES))).alias("mode"))
    df = each.select("vec_id", "mode", pixels.prepared(F.col("pixels"), F.col("width"), F.col("height"), F.col("mode")).alias("p"))
    return df.select("vec_id", "mode", F.col("p.width").cast("bigint").alias("width"), F.col("p.height").cast("bigint").alias("height"), F.md5(F.lower(F.hex("p.pixels"))).alias("digest"))


QUERIES = {f.__name__: f for f in (mask_components, white_text_frames, preprocess_modes)}

# Reachability over neighbours: cells ``c(vec_id, p, x, y)`` of a mask to their component's first place.
_LABEL = """
    r AS (SELECT vec_id, p, x, y, p AS root FROM c UNION SELECT c.vec_id, c.p, c.x, c.y, least(r.root, c.p) FROM r JOIN c ON c.vec_id = r.vec_id AND abs(c.x - r.x) <= 1 AND abs(c.y - r.y) <= 1),
    l AS (SELECT vec_id, p, x, y, min(root) AS root FROM r GROUP BY ALL)
"""


def _mean(rows: str, size: int) -> str:
    """``rows`` (vec_id, x, y, g of 24 by 24) with the Gaussian mean m around each place, those of the edge repeated."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    return f"""
      SELECT vec_id, y, x, any_value(g) AS g, round_even(sum(m0 * w), 0) AS m FROM (
        SELECT q.vec_id, q.y, ww.d AS x, q.m0, ww.w, t.g FROM (SELECT p.vec_id, ww.d AS y, p.x, sum(p.g * ww.w) AS m0 FROM {rows} p JOIN w{size} ww ON ww.s = p.y GROUP BY ALL) q
        JOIN w{size} ww ON ww.s = q.x JOIN {rows} t ON t.vec_id = q.vec_id AND t.y = q.y AND t.x = ww.d) GROUP BY vec_id, y, x""", f"""
    w{size} AS (SELECT d, s, sum(w) / sum(sum(w)) OVER (PARTITION BY d) AS w FROM (SELECT d, greatest(0, least(23, d + o)) AS s, exp(-(o * o) / {2 * sigma * sigma}::DOUBLE) AS w FROM (SELECT unnest(range(24)) AS d), (SELECT unnest(range({-(size // 2)}, {size // 2 + 1})) AS o)) GROUP BY d, s)"""


_MEAN35, _W35 = _mean("soft", 35)
_MEAN31, _W31 = _mean("u3", 31)
ORACLE_SQL = {
    "mask_components": f"""
    WITH RECURSIVE px AS (SELECT vec_id, p, p % 8 AS x, p // 8 AS y, embedding[p + 1]::DOUBLE > 0.05::DOUBLE AS v FROM embeddings, (SELECT unnest(range(64)) AS p) WHERE len(embedding) = 64),
    d AS (SELECT *, max(v) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v1 FROM px),
    e AS (SELECT *, min(v1) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS v2 FROM d),
    f AS (SELECT *, min(v2) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v3 FROM e),
    g AS (SELECT *, max(v3) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v4 FROM f),
    c AS (SELECT vec_id, p, x, y FROM g WHERE v4), {_LABEL},
    s AS (SELECT vec_id, root, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM l GROUP BY vec_id, root)
    SELECT v.vec_id, CASE WHEN root IS NOT NULL THEN row_number() OVER (PARTITION BY v.vec_id ORDER BY root) END AS component, x, y, w, h, area
    FROM (SELECT vec_id FROM embeddings WHERE len(embedding) = 64) v LEFT JOIN s USING (vec_id)
""",
    "white_text_frames": f"""
    WITH RECURSIVE px AS (
      SELECT vec_id, p, p % 8 AS x, p // 8 AS y, greatest(0, least(255, floor(128 + 512 * embedding[p + 1]::DOUBLE + (vec_id % 4) * 16))) >= 180 AND p >= 8 AS v
      FROM embeddings, (SELECT unnest(range(64)) AS p) WHERE len(embedding) = 64),
    b AS (SELECT vec_id, coalesce(sum(24 * CASE WHEN y = 1 THEN 7 ELSE 12 END) FILTER (v), 0) / 18432 AS bright FROM px GROUP BY vec_id),
    c AS (SELECT vec_id, p, x, y FROM px JOIN b USING (vec_id) WHERE v AND bright <= 0.32), {_LABEL},
    t AS (SELECT vec_id, root, CASE x WHEN 0 THEN 0 ELSE 24 * x + 1 END AS xa, least(192, 24 * x + 25) AS xb, CASE y WHEN 1 THEN 18 ELSE 12 * y + 1 END AS ya, least(96, 12 * y + 13) AS yb FROM l),
    s AS (SELECT vec_id, root, min(xa) AS x, min(ya) AS y, max(xb) - min(xa) AS w, max(yb) - min(ya) AS h, sum((xb - xa) * (yb - ya)) AS area FROM t GROUP BY vec_id, root),
    k AS (SELECT * FROM s WHERE h BETWEEN 10 AND 80 AND w >= 18 AND area BETWEEN 35 AND 192 * 96 * 0.18 AND area / (w * h) BETWEEN 0.06 AND 0.82 AND w / h >= 0.35 AND NOT (w > 192 * 0.92 AND h > 96 * 0.45) AND y + h / 2 >= 48),
    n AS (SELECT vec_id, count(*) AS components FROM s GROUP BY vec_id),
    o AS (SELECT vec_id, count(*) AS letters, min(x) AS x1, min(y) AS y1, max(x + w) AS x2, max(y + h) AS y2, sum(area) AS area FROM k GROUP BY vec_id),
    raw AS (SELECT vec_id, 24 * x AS xa, 24 * x + 24 AS xb, CASE y WHEN 1 THEN 17 ELSE 12 * y END AS ya, 12 * y + 12 AS yb FROM px JOIN b USING (vec_id) WHERE v AND bright > 0.32),
    m AS (SELECT vec_id, count(DISTINCT 96 * j + i) AS mask_on FROM (SELECT vec_id, j, unnest(range(xa // 2, (xb - 1) // 2 + 1)) AS i FROM (SELECT *, unnest(range(ya // 3, (yb - 1) // 3 + 1)) AS j FROM (SELECT vec_id, xa, xb, ya, yb FROM t UNION ALL SELECT * FROM raw))) GROUP BY vec_id),
    z AS (SELECT b.vec_id, bright, coalesce(components, 0) AS components, coalesce(letters, 0) AS letters, x1, y1, x2, y2, area, coalesce(mask_on, 0) AS mask_on,
        coalesce((letters >= 2 OR area >= 220) AND x2 - x1 >= 50 AND (x1 + x2) / 2 BETWEEN 192 * 0.18 AND 192 * 0.82 AND (y1 + y2) / 2 >= 48 AND y2 - y1 BETWEEN 10 AND 96 * 0.70
          AND (y2 - y1 <= 45 OR (letters >= 7 AND x2 - x1 >= 96)) AND (bright <= 0.24 OR (letters >= 3 AND bright <= 0.32)), false) AS detected
      FROM b LEFT JOIN n USING (vec_id) LEFT JOIN o USING (vec_id) LEFT JOIN m USING (vec_id))
    SELECT vec_id, round(bright, 6) AS bright, components, letters, x1::BIGINT AS x1, y1::BIGINT AS y1, x2::BIGINT AS x2, y2::BIGINT AS y2, area::BIGINT AS area, detected,
      CASE WHEN detected THEN greatest(0, x1 - 12) END::BIGINT AS crop_x1, CASE WHEN detected THEN greatest(0, y1 - 8) END::BIGINT AS crop_y1,
      CASE WHEN detected THEN least(192, x2 + 12) END::BIGINT AS crop_x2, CASE WHEN detected THEN least(96, y2 + 8) END::BIGINT AS crop_y2, mask_on FROM z
""",
    "preprocess_modes": f"""
    WITH px AS (
      SELECT vec_id, p % 8 AS x, p // 8 AS y, greatest(0, least(255, floor(128 + 512 * embedding[p + 1]::DOUBLE + (vec_id % 4) * 16)))::BIGINT AS v
      FROM embeddings, (SELECT unnest(range(64)) AS p) WHERE len(embedding) = 64),
    ph AS (SELECT k, d, floor((d + 0.5::DOUBLE) / k - 0.5)::BIGINT AS b, (d + 0.5::DOUBLE) / k - 0.5 - floor((d + 0.5::DOUBLE) / k - 0.5) AS f FROM (SELECT unnest([2, 3]) AS k), (SELECT unnest(range(24)) AS d) WHERE d < 8 * k),
    c AS (SELECT *, -0.75 * (((f + 1 - 5) * (f + 1) + 8) * (f + 1) - 4) AS c0, (1.25 * f - 2.25) * f * f + 1 AS c1, (1.25 * (1 - f) - 2.25) * (1 - f) * (1 - f) + 1 AS c2 FROM ph),
    tap AS (SELECT k, d, greatest(0, least(7, b + i - 1)) AS s, round_even(2048 * [c0, c1, c2, 1 - c0 - c1 - c2][i + 1], 0)::BIGINT AS w FROM c, (SELECT unnest(range(4)) AS i)),
    row_ AS (SELECT vec_id, k, y, d AS x, sum(v * w) AS v FROM px JOIN tap ON s = x GROUP BY vec_id, k, y, d),
    up AS MATERIALIZED (SELECT vec_id, row_.k, d AS y, x, greatest(0, least(255, floor((sum(v * w) + 2097152) / 4194304.0::DOUBLE)))::BIGINT AS g FROM row_ JOIN tap ON row_.k = tap.k AND s = y GROUP BY vec_id, row_.k, d, x),
    u3 AS MATERIALIZED (SELECT vec_id, x, y, g FROM up WHERE k = 3),
    lv AS MATERIALIZED (SELECT vec_id, 'threshold' AS mode, x, y, least(255, round_even((g::REAL * 1.55::REAL + 8::REAL)::DOUBLE, 0))::BIGINT AS g FROM u3
      UNION ALL SELECT vec_id, 'simple', x, y, least(255, round_even((g::REAL * 1.35::REAL + 10::REAL)::DOUBLE, 0))::BIGINT FROM up WHERE k = 2),
    hs AS (SELECT vec_id, mode, g, count(*) AS n FROM lv GROUP BY ALL),
    cu AS (SELECT vec_id, mode, g, sum(n) OVER o AS low, sum(n * g) OVER o AS mass, sum(n) OVER a AS total, sum(n * g) OVER a AS whole FROM hs WINDOW o AS (PARTITION BY vec_id, mode ORDER BY g), a AS (PARTITION BY vec_id, mode)),
    ot AS (SELECT vec_id, mode, arg_max(g, (CASE WHEN low < total THEN (whole * low - mass * total)::DOUBLE ** 2 / (low * (total - low))::DOUBLE ELSE 0.0 END, -g)) AS cut FROM cu GROUP BY vec_id, mode),
    near AS (SELECT d, abs(23 - abs(23 - (d + o))) AS s, 2 - abs(o) AS w FROM (SELECT unnest(range(24)) AS d), (SELECT unnest([-1, 0, 1]) AS o)),
    soft AS MATERIALIZED (SELECT vec_id, a.d AS x, b.d AS y, (sum(g * a.w * b.w)::BIGINT + 8) // 16 AS g FROM u3 JOIN near a ON a.s = x JOIN near b ON b.s = y GROUP BY vec_id, a.d, b.d), {_W35}, {_W31},
    ma AS (SELECT vec_id, x, y, g >= 175 OR g - m > 8 AS v FROM ({_MEAN31})),
    di AS (SELECT vec_id, x, y, max(v) OVER (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM (SELECT vec_id, x, y, max(v) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM ma)),
    cl AS (SELECT vec_id, x, y, 255 * (min(v) OVER (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))::BIGINT AS v FROM (SELECT vec_id, x, y, min(v) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS v FROM di)),
    sh AS (SELECT vec_id, x, y, 5 * v - coalesce(lag(v) OVER h, lead(v) OVER h) - coalesce(lead(v) OVER h, lag(v) OVER h) - coalesce(lag(v) OVER u, lead(v) OVER u) - coalesce(lead(v) OVER u, lag(v) OVER u) AS v
      FROM cl WINDOW h AS (PARTITION BY vec_id, y ORDER BY x), u AS (PARTITION BY vec_id, x ORDER BY y)),
    al AS (
      SELECT vec_id, 'none' AS mode, x, y, v AS g FROM px
      UNION ALL SELECT vec_id, 'grayscale', x, y, g FROM u3
      UNION ALL SELECT vec_id, 'contrast', x, y, least(255, round_even(g * 1.75::DOUBLE + 12, 0))::BIGINT FROM u3
      UNION ALL SELECT vec_id, mode, x, y, CASE WHEN g > cut THEN 255 ELSE 0 END FROM lv JOIN ot USING (vec_id, mode)
      UNION ALL SELECT vec_id, 'adaptive', x, y, CASE WHEN g - m > 6 THEN 255 ELSE 0 END FROM ({_MEAN35})
      UNION ALL SELECT vec_id, 'subtitle', x, y, greatest(0, least(255, v)) FROM sh)
    SELECT vec_id, mode, max(x) + 1 AS width, max(y) + 1 AS height, md5(string_agg(printf('%02x', g), '' ORDER BY y, x)) AS digest FROM al GROUP BY vec_id, mode
""",
}
