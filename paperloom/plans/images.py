"""Queries on images; checked pixel by pixel."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions.vectors import normalise_pixels
from paperloom.operators import images as im
from paperloom.plans.fixtures import load
from paperloom.plans.registry import query

I = ("doc_images",)
X = ("doc_pixels",)


def _images(spark, sf):
    return load(spark, sf, "doc_images")


def level_list(column="px"):
    """Binary pixels as a list of numbers."""
    return F.transform(
        F.sequence(F.lit(1), F.length(column)), lambda i: F.conv(F.hex(F.substring(F.col(column), i, F.lit(1))), 16, 10).cast("int")
    )


def levels_of(df, column="px"):
    """Binary pixels to rows ``(doc_id, p, value)``."""
    return df.select("doc_id", F.posexplode(level_list(column)).alias("p", "px"))


# Bicubic weights of 8 source pixels for 16 target pixels in 22-bit fixed point.
RESIZE_SQL = """tap AS (SELECT o, x, k FROM (
    SELECT o, x, CASE WHEN w < 0 THEN ceil(w / sum(w) OVER (PARTITION BY o) * 4194304 - 0.5) ELSE floor(w / sum(w) OVER (PARTITION BY o) * 4194304 + 0.5) END AS k
    FROM (SELECT o, x, CASE WHEN d < 1 THEN (1.5 * d - 2.5) * d * d + 1 WHEN d < 2 THEN ((-0.5 * d + 2.5) * d - 4) * d + 2 ELSE 0 END AS w
      FROM (SELECT o, x, abs(x - (o + 0.5) * 0.5 + 0.5)::DOUBLE AS d FROM (SELECT CAST(unnest(range(0, 16)) AS INT) AS o) a
        CROSS JOIN (SELECT CAST(unnest(range(0, 8)) AS INT) AS x) b
        WHERE x >= greatest(0, trunc((o + 0.5) * 0.5 - 2 + 0.5)) AND x < least(8, trunc((o + 0.5) * 0.5 + 2 + 0.5))) c) e) f),
wide AS (SELECT doc_id, p // 8 AS y, o, greatest(0, least(255, floor((sum(px * k) + 2097152) / 4194304))) AS v
  FROM doc_pixels JOIN tap ON p % 8 = x GROUP BY doc_id, p // 8, o),
big AS (SELECT doc_id, CAST(t.o * 16 + w.o AS INT) AS p, CAST(greatest(0, least(255, floor((sum(v * k) + 2097152) / 4194304))) AS INT) AS px
  FROM wide w JOIN tap t ON w.y = t.x GROUP BY doc_id, t.o, w.o)"""


@query("img_resize", "SELECT * FROM big", X, RESIZE_SQL)
def img_resize(spark, sf):
    return levels_of(im.resize(_images(spark, sf), 16, "bicubic"))


@query("img_normalise", "SELECT doc_id, p, round((px / 255.0::DOUBLE - 0.5) / 0.5, 9) AS value FROM doc_pixels", X)
def img_normalise(spark, sf):
    rows = _images(spark, sf).select("doc_id", F.posexplode(normalise_pixels(F.col("px"))).alias("p", "value"))
    return rows.withColumn("value", F.round("value", 9))


@query("img_flatten", "SELECT doc_id, p, CAST(px AS DOUBLE) AS value FROM doc_pixels", X)
def img_flatten(spark, sf):
    flat = im.pixel_features(_images(spark, sf).drop("split", "label"), 8)
    return flat.select("doc_id", F.posexplode("features").alias("p", "value"))


HOG_SQL = """grad AS (SELECT a.doc_id, a.p // 8 AS y, a.p % 8 AS x,
    CASE WHEN a.p // 8 IN (0, 7) THEN 0 ELSE (d.px - u.px) END / 255.0::DOUBLE AS gy,
    CASE WHEN a.p % 8 IN (0, 7) THEN 0 ELSE (r.px - l.px) END / 255.0::DOUBLE AS gx
  FROM doc_pixels a
  LEFT JOIN doc_pixels u ON u.doc_id = a.doc_id AND u.p = a.p - 8 LEFT JOIN doc_pixels d ON d.doc_id = a.doc_id AND d.p = a.p + 8
  LEFT JOIN doc_pixels l ON l.doc_id = a.doc_id AND l.p = a.p - 1 LEFT JOIN doc_pixels r ON r.doc_id = a.doc_id AND r.p = a.p + 1),
mag AS (SELECT doc_id, y // 2 AS cy, x // 2 AS cx, CAST(least(8, floor(((degrees(atan2(gy, gx)) % 180) + 180) % 180 / 20)) AS INT) AS b, sqrt(gx * gx + gy * gy) AS m FROM grad),
cell AS (SELECT c.doc_id, c.cy, c.cx, c.b, coalesce(sum(m.m), 0) / 4 AS v
  FROM (SELECT DISTINCT doc_id, cy, cx, unnest(range(0, 9))::INT AS b FROM mag) c
  LEFT JOIN mag m ON m.doc_id = c.doc_id AND m.cy = c.cy AND m.cx = c.cx AND m.b = c.b GROUP BY ALL),
blk AS (SELECT c.doc_id, s.r0, s.c0, ((s.r0 * 3 + s.c0) * 4 + (cy - s.r0) * 2 + (cx - s.c0)) * 9 + b AS p, v
  FROM cell c JOIN (SELECT unnest([0,0,0,1,1,1,2,2,2])::INT AS r0, unnest([0,1,2,0,1,2,0,1,2])::INT AS c0) s
  ON cy BETWEEN s.r0 AND s.r0 + 1 AND cx BETWEEN s.c0 AND s.c0 + 1),
once AS (SELECT doc_id, r0, c0, p, least(0.2, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id, r0, c0) + 1e-10)) AS v FROM blk),
hog AS (SELECT doc_id, p, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id, r0, c0) + 1e-10) AS v FROM once)"""


@query("img_hog", "SELECT doc_id, CAST(p AS INT) AS p, round(v, 6) AS value FROM hog", X, HOG_SQL)
def img_hog(spark, sf):
    hog = im.hog_features(_images(spark, sf).drop("split", "label"), 8, 2)
    rows = hog.select("doc_id", F.posexplode("features").alias("p", "value"))
    return rows.withColumn("value", F.round("value", 6))


OTSU_SQL = """lev AS (SELECT doc_id, px AS t, count(*) AS n FROM doc_pixels GROUP BY doc_id, px),
cum AS (SELECT doc_id, t, sum(n) OVER w AS w0, sum(n * t) OVER w AS s0, sum(n) OVER (PARTITION BY doc_id) AS total, sum(n * t) OVER (PARTITION BY doc_id) AS whole
  FROM lev WINDOW w AS (PARTITION BY doc_id ORDER BY t)),
cut AS (SELECT doc_id, t FROM (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY
    pow(CAST(total * s0 - w0 * whole AS DOUBLE), 2) / CAST(w0 * (total - w0) AS DOUBLE) DESC, t) AS r FROM cum WHERE w0 < total) q WHERE r = 1)"""


@query(
    "img_otsu",
    "SELECT x.doc_id, c.t AS threshold, count(*) FILTER (px > c.t) AS n_white FROM doc_pixels x JOIN cut c ON c.doc_id = x.doc_id GROUP BY x.doc_id, c.t",
    X,
    OTSU_SQL,
)
def img_otsu(spark, sf):
    done = im.otsu(_images(spark, sf))
    white = F.length(F.replace(F.hex("binary"), F.lit("00"), F.lit(""))) / 2
    return done.select("doc_id", "threshold", white.cast("bigint").alias("n_white"))


def _drawn(number: int) -> str:
    return f"('0x' || substr(md5(concat(CAST(doc_id AS VARCHAR), ':0:42:{number}')), 1, 7))::BIGINT"


AUGMENT_SQL = f"""drawn AS (SELECT doc_id, {_drawn(0)} % 5 = 0 AS mirror, radians(({_drawn(1)} % 101 - 50)::DOUBLE / 10) AS angle,
    80 + {_drawn(2)} % 41 AS bright, 80 + {_drawn(3)} % 41 AS contrast, {_drawn(4)} % 2 = 1 AS swapped
  FROM (SELECT DISTINCT doc_id FROM doc_pixels WHERE split = 'train') i),
turn AS (SELECT *, CAST(floor(cos(angle) * 65536 + 0.5) AS BIGINT) AS c, CAST(floor(sin(angle) * 65536 + 0.5) AS BIGINT) AS s FROM drawn),
place AS (SELECT t.*, p, (c * (2 * (p % 8) - 7) - s * (2 * (p // 8) - 7) + 8 * 65536 + 131072 * 16) // 131072 - 16 AS fx,
    (s * (2 * (p % 8) - 7) + c * (2 * (p // 8) - 7) + 8 * 65536 + 131072 * 16) // 131072 - 16 AS fy
  FROM turn t CROSS JOIN (SELECT CAST(unnest(range(0, 64)) AS INT) AS p) q),
turned AS (SELECT a.*, coalesce(x.px, 0) AS v FROM place a LEFT JOIN doc_pixels x ON x.doc_id = a.doc_id AND fx BETWEEN 0 AND 7
    AND fy BETWEEN 0 AND 7 AND x.p = fy * 8 + CASE WHEN mirror THEN 7 - fx ELSE fx END),
one AS (SELECT *, least(255, v * bright // 100) AS light,
    least(255, greatest(0, m * 100 + (v - m) * contrast) // 100) AS hard
  FROM (SELECT *, (2 * sum(v) OVER (PARTITION BY doc_id) + 64) // 128 AS m FROM turned) t),
two AS (SELECT doc_id, p, swapped, least(255, hard * bright // 100) AS light_last,
    least(255, greatest(0, m2 * 100 + (light - m2) * contrast) // 100) AS hard_last
  FROM (SELECT *, (2 * sum(light) OVER (PARTITION BY doc_id) + 64) // 128 AS m2 FROM one) o)"""


@query("img_augment", "SELECT doc_id, p, CAST(CASE WHEN swapped THEN light_last ELSE hard_last END AS INT) AS px FROM two", X, AUGMENT_SQL)
def img_augment(spark, sf):
    return levels_of(im.augment(_images(spark, sf).where("split = 'train'")))
