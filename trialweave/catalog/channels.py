"""Queries on channel tables, electrode grids and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import bindings as b
from ..functions.numeric import rounded
from ..operators import channels as ch, geometry as geo
from .registry import query


def _impedance(spark, sf):
    return b.table(spark, sf, "lineitem").select(
        F.concat(F.lit("E"), F.col("l_suppkey").cast("string")).alias("channel"),
        F.col("l_extendedprice").alias("impedance"),
    )


_IMP = """imp AS (SELECT 'E' || l_suppkey AS channel, avg(l_extendedprice) AS impedance
  FROM lineitem GROUP BY ALL)"""


@query("impedance_mean", f"WITH {_IMP} SELECT channel, round(impedance, 4) AS impedance FROM imp")
def impedance_mean(spark, sf):
    return ch.mean_impedance(_impedance(spark, sf)).withColumn("impedance", rounded(F.col("impedance"), 4))


@query("bad_impedance", f"WITH {_IMP} SELECT channel FROM imp WHERE impedance > 50000")
def bad_impedance(spark, sf):
    return ch.bad_impedance(_impedance(spark, sf), 50000.0).select("channel")


@query(
    "bad_impedance_t",
    f"WITH {_IMP} SELECT 'E' || s_suppkey AS channel, coalesce(impedance > 51000, false) AS is_bad "
    "FROM supplier LEFT JOIN imp ON channel = 'E' || s_suppkey",
)
def bad_impedance_t(spark, sf):
    rows = b.table(spark, sf, "supplier").select(
        F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("channel"), F.lit(True).alias("is_bad")
    )
    return ch.reflag_impedance(rows, _impedance(spark, sf), 51000.0)


_NAT_SQL = """cm AS (SELECT c_custkey // 64 AS subject, CAST((c_custkey % 64) // 8 AS INTEGER) AS "row",
    CAST(c_custkey % 8 AS INTEGER) AS col, CASE WHEN c_acctbal >= 3000 THEN c_nationkey END AS channel_number
    FROM customer)"""
_NAMES_SQL = """nm AS (SELECT subject, channel_number,
    'R' || arg_min("row", "row" * 8 + col) || '-C' || arg_min(col, "row" * 8 + col) AS name,
    CASE WHEN count(*) > 1 THEN 'macro' ELSE 'micro' END AS electrode_type
    FROM cm WHERE channel_number IS NOT NULL GROUP BY ALL)"""


def _nation_map(spark, sf):
    key = F.col("c_custkey")
    return b.table(spark, sf, "customer").select(
        F.floor(key / 64).alias("subject"),
        F.floor(F.pmod(key, F.lit(64)) / 8).cast("int").alias("row"),
        F.pmod(key, F.lit(8)).cast("int").alias("col"),
        F.when(F.col("c_acctbal") >= 3000, F.col("c_nationkey")).alias("channel_number"),
    )


@query("channel_names", f"WITH {_NAT_SQL}, {_NAMES_SQL} SELECT * FROM nm")
def channel_names(spark, sf):
    return ch.channel_names(_nation_map(spark, sf))


@query(
    "electrode_type",
    f"""WITH {_NAT_SQL}, {_NAMES_SQL} SELECT cm.subject, cm."row", cm.col,
      'R' || cm."row" || '-C' || cm.col AS name, coalesce(electrode_type, 'micro') AS electrode_type
    FROM cm LEFT JOIN nm ON nm.subject = cm.subject AND nm.name = 'R' || cm."row" || '-C' || cm.col""",
)
def electrode_type(spark, sf):
    chanmap = _nation_map(spark, sf)
    cells = chanmap.select(
        "subject", "row", "col",
        F.concat(F.lit("R"), F.col("row").cast("string"), F.lit("-C"), F.col("col").cast("string")).alias("name"),
    )
    return ch.electrode_types(cells, ch.channel_names(chanmap), ["subject", "name"])


@query(
    "rename_channels",
    f"""WITH {_NAT_SQL}, {_NAMES_SQL} SELECT cm.subject, cm."row", cm.col, cm.channel_number,
      coalesce(nm.name, 'old' || cm.col) AS name FROM cm LEFT JOIN nm USING (subject, channel_number)""",
)
def rename_channels(spark, sf):
    chanmap = _nation_map(spark, sf)
    rows = chanmap.withColumn("name", F.concat(F.lit("old"), F.col("col").cast("string")))
    return ch.rename_channels(rows, ch.channel_names(chanmap), ["subject", "channel_number"])


_TABLE_SQL = """tb AS (SELECT cm.subject, cm."row", cm.col, channel_number, nm.name, nm.electrode_type
    FROM cm JOIN nm USING (subject, channel_number))"""


def _table(spark, sf):
    chanmap = _nation_map(spark, sf)
    names = ch.channel_names(chanmap)
    return ch.chanmap_table(chanmap, names, names)


@query("chanmap_table", f"WITH {_NAT_SQL}, {_NAMES_SQL}, {_TABLE_SQL} SELECT * FROM tb")
def chanmap_table(spark, sf):
    return _table(spark, sf)


@query(
    "sorted_map",
    f"""WITH {_NAT_SQL}, {_NAMES_SQL}, {_TABLE_SQL} SELECT * FROM tb
    ORDER BY subject, channel_number, "row", col""",
)
def sorted_map(spark, sf):
    return ch.sorted_map(_table(spark, sf))


@query(
    "distinct_channels",
    f"""WITH {_NAT_SQL} SELECT DISTINCT subject, channel_number FROM cm
    WHERE channel_number IS NOT NULL ORDER BY 1, 2""",
)
def distinct_channels(spark, sf):
    return ch.distinct_channels(_nation_map(spark, sf))


@query(
    "composite_map",
    f"""WITH {b.GRID_SQL}, sz AS (SELECT subject, max("row") + 1 AS n_rows, max(col) + 1 AS n_cols,
      max(channel_number) + 1 AS n FROM grid GROUP BY subject)
    SELECT subject, "row" + i * (n_rows + 1) AS "row", CAST(col AS BIGINT) AS col,
      channel_number + i * n AS channel_number
    FROM grid JOIN sz USING (subject), range(3) r(i)
    UNION ALL SELECT subject, i * (n_rows + 1) - 1, c, NULL FROM sz, range(1, 3) r(i), range(n_cols) q(c)""",
)
def composite_map(spark, sf):
    return ch.composite_map(b.grid(spark, sf).drop("is_macro"), 3)


@query(
    "parse_coords",
    """SELECT c_custkey, CAST((c_custkey % 64) // 8 AS INTEGER) AS "row", CAST(c_custkey % 8 AS INTEGER) AS col
    FROM customer""",
)
def parse_coords(spark, sf):
    key = F.col("c_custkey")
    names = b.table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(
            F.lit("R"), F.floor(F.pmod(key, F.lit(64)) / 8).cast("string"),
            F.lit("-C"), F.pmod(key, F.lit(8)).cast("string"),
        ).alias("name"),
    )
    return ch.parse_coordinates(names).drop("name")


@query(
    "parse_shaft",
    """SELECT p_partkey, regexp_extract(nm, '^([a-zA-Z]+)([0-9]+)', 1) AS shaft,
      CAST(regexp_extract(nm, '^([a-zA-Z]+)([0-9]+)', 2) AS BIGINT) AS contact
    FROM (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE replace(p_brand, '#', '') END AS nm
          FROM part) WHERE regexp_matches(nm, '^[a-zA-Z]+[0-9]+')""",
)
def parse_shaft(spark, sf):
    rows = b.table(spark, sf, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).otherwise(
            F.translate("p_brand", "#", "")
        ).alias("name"),
    )
    return ch.parse_shafts(rows).drop("name")


@query(
    "dense_contacts",
    """SELECT c_custkey, c_nationkey, CAST(floor(c_acctbal / 100) AS BIGINT) AS number,
      dense_rank() OVER (PARTITION BY c_nationkey ORDER BY CAST(floor(c_acctbal / 100) AS BIGINT)) - 1 AS contact_index
    FROM customer""",
)
def dense_contacts(spark, sf):
    rows = b.table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 100).alias("number")
    )
    return ch.dense_contacts(rows, ["c_nationkey"], "number")


@query(
    "grid_neighbors",
    f"""WITH {b.GRID_SQL}, g AS (SELECT * FROM grid WHERE channel_number IS NOT NULL)
    SELECT a.subject, a."row", a.col, n."row" AS neighbor_row, n.col AS neighbor_col,
      n.channel_number AS neighbor_channel
    FROM g a JOIN g n ON a.subject = n.subject AND abs(a."row" - n."row") <= 1 AND abs(a.col - n.col) <= 1
      AND (a."row" <> n."row" OR a.col <> n.col)""",
)
def grid_neighbors(spark, sf):
    return ch.grid_neighbors(b.grid(spark, sf))


@query(
    "union_bads",
    """SELECT l_suppkey AS channel FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09
    UNION SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000""",
)
def union_bads(spark, sf):
    first = b.table(spark, sf, "lineitem").filter("l_quantity > 49 and l_discount > 0.09D")
    second = b.table(spark, sf, "supplier").filter("s_acctbal > 5000")
    return ch.union_bads(
        [first.select(F.col("l_suppkey").alias("channel")), second.select(F.col("s_suppkey").alias("channel"))]
    )


@query(
    "shared_bads",
    """SELECT s_suppkey AS channel FROM supplier WHERE s_acctbal > 2000 AND s_suppkey IN
    (SELECT l_suppkey FROM lineitem WHERE l_quantity > 49 AND l_discount > 0.09)""",
)
def shared_bads(spark, sf):
    bads = b.table(spark, sf, "supplier").filter("s_acctbal > 2000").select(F.col("s_suppkey").alias("channel"))
    present = b.table(spark, sf, "lineitem").filter("l_quantity > 49 and l_discount > 0.09D")
    return ch.shared_bads(bads, present.select(F.col("l_suppkey").alias("channel")), ["channel"])


@query(
    "sig_minus_bad",
    """SELECT DISTINCT l_partkey AS channel FROM lineitem WHERE l_quantity > 40
    EXCEPT SELECT p_partkey FROM part WHERE p_size > 30""",
)
def sig_minus_bad(spark, sf):
    sig = b.table(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("channel"))
    bad = b.table(spark, sf, "part").filter("p_size > 30").select(F.col("p_partkey").alias("channel"))
    return ch.significant_minus_bad(sig.distinct(), bad, ["channel"])


@query(
    "match_electrodes",
    """SELECT c_custkey AS channel, c_acctbal AS x, c_custkey * 2 AS "order" FROM customer
    WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""",
)
def match_electrodes(spark, sf):
    used = b.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("channel"))
    positions = b.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("channel"), F.col("c_acctbal").alias("x"),
        (F.col("c_custkey") * 2).alias("order"),
    )
    return ch.match_electrodes(used, positions, ["channel"])


@query(
    "spatial_avg",
    f"""WITH {b.GRID_SQL}, v AS (SELECT c_custkey // 64 AS subject, c_custkey % 64 AS channel_number,
      c_acctbal AS value FROM customer)
    SELECT subject, "row" // 2 AS block_row, col // 2 AS block_col, round(avg(value), 4) AS value,
      count(value) AS n_channels FROM grid JOIN v USING (subject, channel_number) GROUP BY ALL""",
)
def spatial_avg(spark, sf):
    values = b.table(spark, sf, "customer").select(
        F.floor(F.col("c_custkey") / 64).alias("subject"),
        F.pmod("c_custkey", F.lit(64)).cast("int").alias("channel_number"),
        F.col("c_acctbal").alias("value"),
    )
    out = ch.spatial_average(values, b.grid(spark, sf), 2)
    return out.withColumn("value", rounded(F.col("value"), 4))


@query(
    "grid_coords",
    f"""WITH {b.GRID_SQL}, sz AS (SELECT subject, max("row") + 1 AS n_rows, max(col) + 1 AS n_cols
      FROM grid GROUP BY subject)
    SELECT subject, 'R' || "row" || '-C' || col AS name, (col + 0.5::DOUBLE) / n_cols AS x,
      (n_rows - "row" - 0.5::DOUBLE) / n_rows AS y, 0.0::DOUBLE AS z
    FROM grid JOIN sz USING (subject) WHERE channel_number IS NOT NULL""",
)
def grid_coords(spark, sf):
    return geo.grid_positions(b.grid(spark, sf))


@query(
    "electrode_scan",
    """SELECT s_suppkey, 'SUP' || s_suppkey AS name, s_acctbal / 10 AS x, CAST(s_nationkey AS DOUBLE) AS y,
      -s_acctbal AS z FROM supplier""",
)
def electrode_scan(spark, sf):
    lines = b.table(spark, sf, "supplier").select(
        "s_suppkey",
        F.concat_ws(
            " ", F.lit("SUP"), F.col("s_suppkey").cast("string"),
            F.concat(F.lit(" "), (F.col("s_acctbal") / 10).cast("string")),
            F.col("s_nationkey").cast("string"),
            F.concat((-F.col("s_acctbal")).cast("string"), F.lit("  R G")),
        ).alias("value"),
    )
    return geo.parse_electrodes(lines)


@query(
    "split_hemi",
    """SELECT c_custkey, name, x, CASE WHEN starts_with(name, 'L') THEN 'lh' WHEN starts_with(name, 'R')
      THEN 'rh' WHEN x < 0 THEN 'lh' ELSE 'rh' END AS hemi
    FROM (SELECT c_custkey, (['LA','RA','E','G'])[c_custkey % 4 + 1] || c_custkey AS name,
      c_acctbal - 4000 AS x FROM customer)""",
)
def split_hemi(spark, sf):
    prefix = F.get(F.array(*[F.lit(p) for p in ("LA", "RA", "E", "G")]), (F.col("c_custkey") % 4).cast("int"))
    rows = b.table(spark, sf, "customer").select(
        "c_custkey", F.concat(prefix, F.col("c_custkey").cast("string")).alias("name"),
        (F.col("c_acctbal") - 4000).alias("x"),
    )
    return geo.split_hemispheres(rows)


@query(
    "minmax_values",
    """SELECT c_custkey, c_nationkey, c_acctbal AS value, round(CASE WHEN lo = hi THEN 0.5
      ELSE (c_acctbal - lo) / (hi - lo) END, 6) AS scaled FROM (SELECT *,
      min(c_acctbal) OVER w AS lo, max(c_acctbal) OVER w AS hi FROM customer
      WINDOW w AS (PARTITION BY c_nationkey))""",
)
def minmax_values(spark, sf):
    rows = b.table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("value"))
    out = geo.minmax_values(rows, ["c_nationkey"])
    return out.withColumn("scaled", rounded(F.col("scaled")))


@query(
    "minmax_sizes",
    """SELECT c_custkey, c_nationkey, value, round(CASE WHEN lo = hi THEN 0.85
      ELSE 0.2 + 1.3 * (abs(value) - lo) / (hi - lo) END, 6) AS size FROM (SELECT *,
      min(abs(value)) OVER w AS lo, max(abs(value)) OVER w AS hi
      FROM (SELECT c_custkey, c_nationkey, c_acctbal - 4000 AS value FROM customer)
      WINDOW w AS (PARTITION BY c_nationkey))""",
)
def minmax_sizes(spark, sf):
    rows = b.table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", (F.col("c_acctbal") - 4000).alias("value")
    )
    out = geo.minmax_sizes(rows, ["c_nationkey"])
    return out.withColumn("size", rounded(F.col("size")))


@query(
    "region_report",
    """SELECT s_name AS channel, coalesce(r_name, 'unknown') AS region,
      printf('%.6f', s_acctbal) AS feature_value
    FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey <> 0
      LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def region_report(spark, sf):
    supplier = b.table(spark, sf, "supplier")
    nation = b.table(spark, sf, "nation").filter("n_regionkey <> 0")
    regions = (
        supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(b.table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("s_name").alias("channel"), F.col("r_name").alias("region"))
    )
    values = supplier.select(F.col("s_name").alias("channel"), F.col("s_acctbal").alias("value"))
    return geo.region_report(values, regions)


@query(
    "flood_fill",
    f"""WITH RECURSIVE {b.GRID_SQL}, e AS (SELECT subject, "row", col FROM grid WHERE channel_number IS NULL),
    reach AS (
      SELECT e.subject, e."row", e.col, g.channel_number FROM e JOIN grid g ON g.subject = e.subject
        AND g.is_macro AND g.channel_number IS NOT NULL
        AND abs(g."row" - e."row") <= 1 AND abs(g.col - e.col) <= 1
      UNION SELECT e.subject, e."row", e.col, r.channel_number FROM e JOIN reach r ON r.subject = e.subject
        AND abs(r."row" - e."row") <= 1 AND abs(r.col - e.col) <= 1)
    SELECT subject, "row", col, channel_number FROM grid WHERE channel_number IS NOT NULL
    UNION ALL SELECT e.subject, e."row", e.col, min(r.channel_number) AS channel_number
      FROM e LEFT JOIN reach r USING (subject, "row", col) GROUP BY ALL""",
)
def flood_fill(spark, sf):
    return geo.flood_fill(b.grid(spark, sf))


@query(
    "nearest_vertex",
    """WITH v AS (SELECT vec_id, label % 2 AS hemi, CAST(embedding[1] AS DOUBLE) AS x,
      CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings),
    e AS (SELECT p_partkey AS name, p_partkey % 2 AS hemi, sin(p_partkey) / 5 AS x, cos(p_partkey) / 5 AS y,
      sin(p_partkey * 3) / 5 AS z FROM part)
    SELECT name, hemi, arg_min(vec_id, d2) AS vertex, round(sqrt(min(d2)), 6) AS distance FROM (
      SELECT e.name, e.hemi, v.vec_id, (e.x-v.x)*(e.x-v.x)+(e.y-v.y)*(e.y-v.y)+(e.z-v.z)*(e.z-v.z) AS d2
      FROM e JOIN v USING (hemi)) GROUP BY ALL""",
)
def nearest_vertex(spark, sf):
    e = F.col("embedding")
    vertices = b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("vertex"), (F.col("label") % 2).cast("long").alias("hemi"),
        *[F.element_at(e, i).cast("double").alias(n) for i, n in ((1, "x"), (2, "y"), (3, "z"))],
    )
    key = F.col("p_partkey")
    points = b.table(spark, sf, "part").select(
        key.alias("name"), (key % 2).alias("hemi"), (F.sin(key) / 5).alias("x"), (F.cos(key) / 5).alias("y"),
        (F.sin(key * 3) / 5).alias("z"),
    )
    out = geo.nearest_vertex(points, vertices, ["hemi"], "name")
    return out.withColumn("distance", rounded(F.col("distance")))


_SURFACES = """v AS (SELECT vec_id AS vertex, label % 2 AS hemi, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y,
      CAST(embedding[3] AS DOUBLE) AS z, CAST(embedding[4] AS DOUBLE) AS sx, CAST(embedding[5] AS DOUBLE) AS sy,
      CAST(embedding[6] AS DOUBLE) AS sz FROM embeddings),
    pial AS (SELECT s AS subject, vertex, hemi, x + s / 50 AS x, y, z FROM v, range(3) r(s)),
    sphere AS (SELECT s AS subject, vertex, hemi, sx, sy + s / 50 AS sy, sz FROM v, range(3) r(s)),
    e AS (SELECT p_partkey % 3 AS subject, p_partkey AS name, p_partkey // 3 % 2 AS hemi, sin(p_partkey) / 5 AS x,
      cos(p_partkey) / 5 AS y, sin(p_partkey * 3) / 5 AS z FROM part)"""


@query(
    "project_electrodes",
    f"""WITH {_SURFACES}, a AS (SELECT e.subject, e.hemi, e.name, arg_min(p.vertex, struct_pack(d := (e.x-p.x)*(e.x-p.x)
        + (e.y-p.y)*(e.y-p.y) + (e.z-p.z)*(e.z-p.z), v := p.vertex)) AS vertex
      FROM e JOIN pial p USING (subject, hemi) GROUP BY ALL),
    s AS (SELECT a.subject, a.hemi, a.name, sx, sy, sz FROM a JOIN sphere USING (subject, hemi, vertex)),
    t AS (SELECT s.subject, s.hemi, s.name, arg_min(v.vertex, struct_pack(d := (s.sx-v.sx)*(s.sx-v.sx)
        + (s.sy-v.sy)*(s.sy-v.sy) + (s.sz-v.sz)*(s.sz-v.sz), v := v.vertex)) AS vertex
      FROM s JOIN v USING (hemi) GROUP BY ALL)
    SELECT t.subject, t.name, t.hemi, t.vertex, x, y, z FROM t JOIN v USING (hemi, vertex)""",
)
def project_electrodes(spark, sf):
    """Subject surfaces are shifted copies of the template, which is cut from the vectors."""
    e = F.col("embedding")
    v = b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("vertex"), (F.col("label") % 2).cast("long").alias("hemi"),
        *[F.element_at(e, i).cast("double").alias(n) for i, n in enumerate(("x", "y", "z", "sx", "sy", "sz"), 1)],
    )
    each = v.withColumn("subject", F.explode(F.array(*[F.lit(i).cast("long") for i in range(3)])))
    place = ["subject", "hemi", "vertex"]
    pial = each.select(*place, (F.col("x") + F.col("subject") / 50).alias("x"), "y", "z")
    sphere = each.select(*place, F.col("sx").alias("x"), (F.col("sy") + F.col("subject") / 50).alias("y"), F.col("sz").alias("z"))
    template_sphere = v.select("hemi", "vertex", F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z"))
    key = F.col("p_partkey")
    electrodes = b.table(spark, sf, "part").select(
        (key % 3).alias("subject"), key.alias("name"), F.pmod(F.floor(key / 3), F.lit(2)).alias("hemi"),
        (F.sin(key) / 5).alias("x"), (F.cos(key) / 5).alias("y"), (F.sin(key * 3) / 5).alias("z"),
    )
    return geo.project_electrodes(electrodes, pial, sphere, template_sphere, v.select("hemi", "vertex", "x", "y", "z"))
