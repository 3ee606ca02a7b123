"""Scene tasks: counts, sizes, distances and directions between annotated objects."""

from __future__ import annotations

from pyspark.sql import functions as F

from scenery.functions import geometry as g
from scenery.operators import lookup, nearest
from scenery.operators.selection import percentile
from scenery.plans.catalogue import query
from scenery.sources.adapters import spark_view, with_views

UNIQUE = """counted AS (SELECT *, count(*) OVER (PARTITION BY scene_id, label) AS n FROM objects), uniq AS (SELECT * FROM counted WHERE n = 1)"""
FUNIQUE = """seen AS (SELECT * FROM objects WHERE visibility >= 0.5), counted AS (SELECT *, count(*) OVER (PARTITION BY scene_id, frame_id, label) AS n FROM seen), uniq AS (SELECT * FROM counted WHERE n = 1)"""
DIR8_SQL = "list_extract(['right','front-right','front','front-left','left','back-left','back','back-right'], 1 + CAST(floor(((degrees(atan2({y}, {x})) + 360) % 360 + 22.5) / 45) AS INT) % 8)"


def sql_dir8(x: str, y: str) -> str:
    """The eight-way label in SQL; the angle is brought to 0..360 first."""
    return DIR8_SQL.format(x=x, y=y)


def objects(spark, sf):
    return spark_view(spark, sf, "objects")


def unique(spark, sf):
    return lookup.unique_objects(objects(spark, sf), "scene_id")


def unique_seen(spark, sf):
    return lookup.unique_objects(lookup.visible(objects(spark, sf)), "scene_id", "frame_id")


@query("t03_absolute_distance", with_views("objects", rest=UNIQUE) + """
SELECT a.scene_id, a.label AS label_1, b.label AS label_2,
       concat(CAST(round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), 2) AS VARCHAR), ' meters') AS answer
FROM uniq a JOIN uniq b ON a.scene_id = b.scene_id AND a.label < b.label""")
def absolute_distance(spark, sf):
    """Centre distance of every pair of uniquely labelled objects of a scene."""
    p = lookup.pairs(unique(spark, sf).select("scene_id", "label", "x", "y", "z"), "scene_id")
    d = g.euclid([F.col(f"{c}_1") for c in "xyz"], [F.col(f"{c}_2") for c in "xyz"])
    return p.select("scene_id", "label_1", "label_2", F.concat(F.round(d, 2).cast("string"), F.lit(" meters")).alias("answer"))


@query("t01_object_counting", with_views("objects") + "SELECT scene_id, label, count(*) AS answer, count(*) >= 2 AS is_valid FROM objects GROUP BY scene_id, label")
def object_counting(spark, sf):
    """Objects of each category; only categories of two or more make a question."""
    return objects(spark, sf).groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("answer")).withColumn("is_valid", F.col("answer") >= 2)


@query("t02_object_size", with_views("objects", rest=UNIQUE) + """
SELECT scene_id, label, concat(CAST(round(100 * greatest(abs(x1-x0), abs(y1-y0), abs(z1-z0)), 2) AS VARCHAR), ' cm') AS answer FROM uniq""")
def object_size(spark, sf):
    """Longest side of each uniquely labelled object."""
    side = 100 * F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")), F.abs(F.col("z1") - F.col("z0")))
    return unique(spark, sf).select("scene_id", "label", F.concat(F.round(side, 2).cast("string"), F.lit(" cm")).alias("answer"))


@query("t04_relative_distance", with_views("objects", rest=UNIQUE) + """,
d AS (SELECT a.scene_id, a.label AS target, b.label AS candidate, b.object_id AS pos,
      round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), 2) AS d
      FROM uniq a JOIN uniq b ON a.scene_id = b.scene_id AND a.label <> b.label),
r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, target ORDER BY d, pos) AS k FROM d)
SELECT scene_id, target, candidate AS answer, d AS distance FROM r WHERE k = 1""")
def relative_distance(spark, sf):
    """For each target the nearest other object; distances are rounded first, the first listed wins ties."""
    u = unique(spark, sf)
    found = nearest.nearest(u, ["scene_id"], "object_id")
    target = u.select("scene_id", "object_id", F.col("label").alias("target"))
    return found.join(target, ["scene_id", "object_id"]).join(u.select("scene_id", F.col("object_id").alias("near"), F.col("label").alias("answer")), ["scene_id", "near"]).select("scene_id", "target", "answer", "distance")


@query("j05_nearest_objects", with_views("objects") + """, d AS (SELECT a.label, a.object_id, b.object_id AS near, round(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)), 2) AS distance
  FROM objects a JOIN objects b ON a.label = b.label AND a.object_id <> b.object_id)
SELECT label, object_id, near, distance FROM (SELECT *, row_number() OVER (PARTITION BY label, object_id ORDER BY distance, near) AS k FROM d) WHERE k = 1""")
def nearest_objects(spark, sf):
    """J5 and O2 over whole tables: of every object the nearest of its label, by grids whatever the number."""
    return nearest.nearest(objects(spark, sf), ["label"], "object_id", direct=0)


_REL = """,
t AS (SELECT a.scene_id, a.label AS positioning, b.label AS orienting, c.label AS querying,
      b.x-a.x AS fx, b.y-a.y AS fy, b.z-a.z AS fz, c.x-a.x AS qx, c.y-a.y AS qy, c.z-a.z AS qz
      FROM uniq a JOIN uniq b ON a.scene_id=b.scene_id AND a.label<>b.label JOIN uniq c ON a.scene_id=c.scene_id AND c.label<>a.label AND c.label<>b.label),
u AS (SELECT *, sqrt(fx*fx+fy*fy+fz*fz)+1e-8 AS fn, sqrt(qx*qx+qy*qy+qz*qz)+1e-8 AS qn FROM t),
v AS (SELECT *, (fx/fn)*(qx/qn)+(fy/fn)*(qy/qn) AS ahead, (fy/fn)*(qx/qn)-(fx/fn)*(qy/qn) AS side FROM u),
w AS (SELECT *, CASE WHEN abs(ahead) < 0.3 THEN CASE WHEN side > 0 THEN 'right' ELSE 'left' END
      WHEN abs(side) < 0.3 THEN CASE WHEN ahead > 0 THEN 'front' ELSE 'back' END
      ELSE CASE WHEN ahead > 0 THEN 'front' ELSE 'back' END || '-' || CASE WHEN side > 0 THEN 'right' ELSE 'left' END END AS hard FROM v)
SELECT scene_id, positioning, orienting, querying, hard, CASE WHEN contains(hard,'left') THEN 'left' ELSE 'right' END AS easy,
       CASE WHEN contains(hard,'front') THEN 'front' WHEN contains(hard,'left') THEN 'left' WHEN contains(hard,'right') THEN 'right' ELSE 'back' END AS medium FROM w"""


@query("t05_relative_direction", with_views("objects", rest=UNIQUE) + _REL)
def relative_direction(spark, sf):
    """Where a third object lies for someone at the first who faces the second, at three difficulties."""
    u = unique(spark, sf).select("scene_id", "label", "x", "y", "z")
    side = lambda name, k: u.select("scene_id", F.col("label").alias(name), *[F.col(c).alias(f"{c}{k}") for c in "xyz"])
    t = side("positioning", "a").join(side("orienting", "b"), "scene_id").where("positioning <> orienting")
    t = t.join(side("querying", "c"), "scene_id").where("querying <> positioning AND querying <> orienting")
    at = lambda k: [F.col(f"{c}{k}") for c in "xyz"]
    t = t.withColumn("hard", g.relative_direction(at("a"), at("b"), at("c")))
    return t.select("scene_id", "positioning", "orienting", "querying", "hard", g.coarse_direction(F.col("hard"), "easy").alias("easy"), g.coarse_direction(F.col("hard"), "medium").alias("medium"))


_SINGLE = """,
t AS (SELECT a.scene_id, a.frame_id, a.label AS label_1, b.label AS label_2, b.cx-a.cx AS r, b.cz-a.cz AS f, -(b.cy-a.cy) AS u FROM uniq a JOIN uniq b
      ON a.scene_id=b.scene_id AND a.frame_id=b.frame_id AND a.label<b.label)
SELECT scene_id, frame_id, label_1, label_2, CASE WHEN sqrt(r*r+f*f) < 1e-8 THEN CASE WHEN abs(u) < 1e-8 THEN 'overlap' WHEN u > 0 THEN 'up' ELSE 'down' END
  WHEN abs(u) > 0.5*sqrt(r*r+f*f) THEN CASE WHEN u > 0 THEN 'up' ELSE 'down' END || '-' || CASE WHEN abs(r) >= abs(f) THEN CASE WHEN r > 0 THEN 'right' ELSE 'left' END ELSE CASE WHEN f > 0 THEN 'front' ELSE 'back' END END
  ELSE """ + sql_dir8("r", "f") + " END AS answer FROM t"


def _frame_pairs(spark, sf, *columns):
    return lookup.pairs(unique_seen(spark, sf).select("scene_id", "frame_id", "label", *columns), "scene_id", "frame_id")


@query("t07_single_image_direction", with_views("objects", rest=FUNIQUE) + _SINGLE)
def single_image_direction(spark, sf):
    """Direction from one to another uniquely visible object, in the camera's frame."""
    p = _frame_pairs(spark, sf, "cx", "cy", "cz")
    d = lambda c: F.col(f"{c}_2") - F.col(f"{c}_1")
    return p.select("scene_id", "frame_id", "label_1", "label_2", g.single_direction(d("cx"), d("cz"), -d("cy")).alias("answer"))


@query("t08_distance_cam_obj", with_views("objects", "poses", rest=FUNIQUE) + """,
d AS (SELECT u.scene_id, u.frame_id, u.label, sqrt(power(p.tx - greatest(u.x0, least(p.tx, u.x1)), 2) + power(p.ty - greatest(u.y0, least(p.ty, u.y1)), 2) + power(p.tz - greatest(u.z0, least(p.tz, u.z1)), 2)) AS d
      FROM uniq u JOIN poses p ON u.scene_id = p.scene_id AND u.frame_id = p.frame_id)
SELECT scene_id, frame_id, label, round(d, 2) AS answer, CASE WHEN d < 1 THEN 'near' WHEN d < 2.5 THEN 'medium' ELSE 'far' END AS bucket FROM d""")
def distance_cam_obj(spark, sf):
    """Camera's distance to the nearest point of each uniquely visible object's box."""
    u = unique_seen(spark, sf).join(spark_view(spark, sf, "poses").select("scene_id", "frame_id", "tx", "ty", "tz"), ["scene_id", "frame_id"])
    d = g.point_box_distance(g.col3("t"), [F.col(f"{c}0") for c in "xyz"], [F.col(f"{c}1") for c in "xyz"], g.col3(""))
    return u.withColumn("d", d).select("scene_id", "frame_id", "label", F.round("d", 2).alias("answer"), g.distance_bucket(F.col("d")).alias("bucket"))


@query("t09_depth_order", with_views("objects", rest=FUNIQUE) + """
SELECT a.scene_id, a.frame_id, a.label AS label_1, b.label AS label_2, CASE WHEN abs(a.cz-b.cz) <= 0.15 THEN 'same' WHEN a.cz < b.cz THEN a.label ELSE b.label END AS answer
FROM uniq a JOIN uniq b ON a.scene_id=b.scene_id AND a.frame_id=b.frame_id AND a.label<b.label""")
def depth_order(spark, sf):
    """Which of two uniquely visible objects is closer to the camera."""
    p = _frame_pairs(spark, sf, "cz")
    return p.select("scene_id", "frame_id", "label_1", "label_2", g.depth_order(F.col("cz_1"), F.col("cz_2"), F.col("label_1"), F.col("label_2")).alias("answer"))


_ROT = """rot AS (SELECT *, sqrt(ax*ax+ay*ay+az*az) AS th FROM poses), nrm AS (SELECT *, ax/th AS nx, ay/th AS ny, az/th AS nz, sin(th) AS s, cos(th) AS c, 1-cos(th) AS w FROM rot),
cam AS (SELECT scene_id, frame_id, tx, ty, tz, c+nx*nx*w AS r0, nx*ny*w-nz*s AS r1, nx*nz*w+ny*s AS r2, ny*nx*w+nz*s AS r3, c+ny*ny*w AS r4, ny*nz*w-nx*s AS r5, nz*nx*w-ny*s AS r6, nz*ny*w+nx*s AS r7, c+nz*nz*w AS r8 FROM nrm),
loc AS (SELECT a.scene_id, a.frame_id AS frame_1, b.frame_id AS frame_2, a.tz AS z1, b.tz AS z2,
  a.r0*(b.tx-a.tx)+a.r3*(b.ty-a.ty)+a.r6*(b.tz-a.tz) AS lx, a.r1*(b.tx-a.tx)+a.r4*(b.ty-a.ty)+a.r7*(b.tz-a.tz) AS ly, a.r2*(b.tx-a.tx)+a.r5*(b.ty-a.ty)+a.r8*(b.tz-a.tz) AS lz,
  sqrt(power(b.tx-a.tx,2)+power(b.ty-a.ty,2)+power(b.tz-a.tz,2)) AS d, a.r2 AS f1x, a.r8 AS f1z, b.r2 AS f2x, b.r8 AS f2z
  FROM cam a JOIN cam b ON a.scene_id=b.scene_id AND a.frame_id<b.frame_id)"""


def cameras(spark, sf):
    """Poses with the nine numbers of their rotation."""
    p = spark_view(spark, sf, "poses")
    r = g.rotation(F.col("ax"), F.col("ay"), F.col("az"))
    return p.select("scene_id", "frame_id", "tx", "ty", "tz", *[m.alias(f"r{i}") for i, m in enumerate(r)])


def camera_pairs(spark, sf, poses=None):
    """Pairs of a scene's poses, the first earlier, with the second in the first's frame."""
    p = lookup.ordered_pairs(cameras(spark, sf) if poses is None else poses, "scene_id", "frame_id")
    p = p.withColumnsRenamed({"frame_id_1": "frame_1", "frame_id_2": "frame_2"})
    t1, t2 = [F.col(f"t{k}_1") for k in "xyz"], [F.col(f"t{k}_2") for k in "xyz"]
    local = g.to_camera(t2, [F.col(f"r{i}_1") for i in range(9)], t1)
    return p.withColumns({"lx": local[0], "ly": local[1], "lz": local[2], "d": g.euclid(t2, t1)})


@query("t10_position_cam_cam", with_views("poses", rest=_ROT) + f"SELECT scene_id, frame_1, frame_2, {sql_dir8('lx', 'ly')} AS answer, round(d, 3) + 0.0 AS distance FROM loc")
def position_cam_cam(spark, sf):
    """Direction of the second camera in the first's frame; the local y counts as front, as it did."""
    return camera_pairs(spark, sf).select("scene_id", "frame_1", "frame_2", g.dir8(F.col("lx"), F.col("ly")).alias("answer"), g.tidy(F.col("d"), 3).alias("distance"))


@query("t11_elevation_cam_cam", with_views("poses", rest=_ROT) + "SELECT scene_id, frame_1, frame_2, CASE WHEN abs(z2-z1) <= 0.15 THEN 'same_level' WHEN z2 > z1 THEN 'higher' ELSE 'lower' END AS answer, abs(z2-z1) > 0.15 AS is_valid FROM loc")
def elevation_cam_cam(spark, sf):
    """Whether the second camera stands higher; a question about the same level is invalid."""
    p = camera_pairs(spark, sf).withColumn("answer", g.elevation(F.col("tz_1"), F.col("tz_2")))
    return p.select("scene_id", "frame_1", "frame_2", "answer", (F.col("answer") != "same_level").alias("is_valid"))


@query("g19_camera_pair", with_views("poses", rest=_ROT) + """
SELECT l.scene_id, frame_1, frame_2, round(lx,6)+0.0 AS lx, round(ly,6)+0.0 AS ly, round(lz,6)+0.0 AS lz,
  round(b.r0*a.r0+b.r1*a.r1+b.r2*a.r2,6)+0.0 AS q00, round(b.r3*a.r3+b.r4*a.r4+b.r5*a.r5,6)+0.0 AS q11, round(b.r6*a.r6+b.r7*a.r7+b.r8*a.r8,6)+0.0 AS q22
FROM loc l JOIN cam a ON a.scene_id=l.scene_id AND a.frame_id=frame_1 JOIN cam b ON b.scene_id=l.scene_id AND b.frame_id=frame_2""")
def camera_pair(spark, sf):
    """Local vector and the diagonal of the relative rotation."""
    p = camera_pairs(spark, sf)
    q = g.relative_rotation([F.col(f"r{i}_2") for i in range(9)], [F.col(f"r{i}_1") for i in range(9)])
    p = p.withColumns({f"q{i}{i}": q[4 * i] for i in range(3)})
    return p.select("scene_id", "frame_1", "frame_2", *[g.tidy_fast(F.col(c)).alias(c) for c in ("lx", "ly", "lz", "q00", "q11", "q22")])


@query("t15_motion_camera", with_views("poses", rest=_ROT) + """,
steps AS (SELECT scene_id, frame_id, r2 AS fx, r8 AS fz, lag(r2) OVER w AS gx, lag(r8) OVER w AS gz FROM cam WINDOW w AS (PARTITION BY scene_id ORDER BY frame_id)),
yaw AS (SELECT scene_id, frame_id, degrees(atan2((gx/sqrt(gx*gx+gz*gz))*(fz/sqrt(fx*fx+fz*fz)) - (gz/sqrt(gx*gx+gz*gz))*(fx/sqrt(fx*fx+fz*fz)),
  greatest(-1.0, least(1.0, (gx/sqrt(gx*gx+gz*gz))*(fx/sqrt(fx*fx+fz*fz)) + (gz/sqrt(gx*gx+gz*gz))*(fz/sqrt(fx*fx+fz*fz)))))) AS turn FROM steps),
turned AS (SELECT l.*, (SELECT sum(turn) FROM yaw y WHERE y.scene_id=l.scene_id AND y.frame_id > l.frame_1 AND y.frame_id <= l.frame_2) AS yaw FROM loc l),
sized AS (SELECT *, abs(lx) AS sx, abs(ly) AS sy, abs(lz) AS sz, sqrt(lx*lx+ly*ly+lz*lz) AS len, CASE WHEN lx>0 THEN 'right' ELSE 'left' END AS nx, CASE WHEN ly<0 THEN 'up' ELSE 'down' END AS ny, CASE WHEN lz>0 THEN 'front' ELSE 'back' END AS nz FROM turned),
places AS (SELECT *, 1 + (sz > sx)::INT + (sy > sx)::INT AS px, 1 + (sx >= sz)::INT + (sy > sz)::INT AS pz, 1 + (sx >= sy)::INT + (sz >= sy)::INT AS py, greatest(sx,sy,sz) AS a, list_sort([sx,sy,sz])[2] AS b FROM sized)
SELECT scene_id, frame_1, frame_2, round(yaw, 4) + 0.0 AS yaw, CASE WHEN abs(yaw) >= 8 THEN CASE WHEN yaw > 0 THEN 'left' ELSE 'right' END WHEN a < 1e-8 THEN 'same'
  WHEN b >= 1e-8 AND b/a >= 0.35 AND b/len >= 0.25 THEN concat_ws('-', CASE WHEN px <= 2 THEN nx END, CASE WHEN pz <= 2 THEN nz END, CASE WHEN py <= 2 THEN ny END)
  WHEN px = 1 THEN nx WHEN pz = 1 THEN nz ELSE ny END AS answer FROM places""")
def motion_camera(spark, sf):
    """Camera motion between two poses: the turn over all poses between them, else the strongest axes."""
    from pyspark.sql import Window

    w = Window.partitionBy("scene_id").orderBy("frame_id")
    c = cameras(spark, sf).withColumns({"gx": F.lag("r2").over(w), "gz": F.lag("r8").over(w)})
    turn = F.coalesce(g.signed_yaw(F.col("gx"), F.col("gz"), F.col("r2"), F.col("r8")), F.lit(0.0))
    # A running total makes the sum over any range of poses a difference: no range join is needed.
    # It goes along with its pose, so pairs are never shuffled.
    c = c.withColumn("turn", turn).withColumn("total", F.sum("turn").over(w)).drop("gx", "gz", "turn")
    p = camera_pairs(spark, sf, c).withColumn("yaw", F.col("total_2") - F.col("total_1"))
    return p.select("scene_id", "frame_1", "frame_2", g.tidy_fast(F.col("yaw"), 4).alias("yaw"), g.motion(F.col("yaw"), F.col("lx"), F.col("ly"), F.col("lz")).alias("answer"))


@query("j08_frame_range", with_views("poses") + """
SELECT a.scene_id, a.frame_id AS frame_1, b.frame_id AS frame_2, count(*) AS n_poses FROM poses a JOIN poses b ON a.scene_id=b.scene_id AND a.frame_id<b.frame_id
JOIN poses m ON m.scene_id=a.scene_id AND m.frame_id BETWEEN a.frame_id AND b.frame_id GROUP BY 1,2,3""")
def frame_range(spark, sf):
    """Poses within the frame range of each pair: a pose's place in its scene makes the count a difference."""
    from pyspark.sql import Window

    w = Window.partitionBy("scene_id").orderBy("frame_id")
    p = spark_view(spark, sf, "poses").select("scene_id", "frame_id", F.row_number().over(w).alias("place"))
    p = lookup.ordered_pairs(p, "scene_id", "frame_id")
    return p.select("scene_id", F.col("frame_id_1").alias("frame_1"), F.col("frame_id_2").alias("frame_2"), (F.col("place_2") - F.col("place_1") + 1).cast("long").alias("n_poses"))


_TWO = """a AS (SELECT scene_id, frame_id, label, count(*) AS n, max(score) AS s, max(visibility) AS v FROM scored WHERE visibility >= 0.5 GROUP BY 1,2,3),
fp AS (SELECT coalesce(a.scene_id, b.scene_id) AS scene_id, coalesce(a.frame_id, b.frame_id - 1) AS frame_1, coalesce(a.label, b.label) AS label, coalesce(a.n,0) AS n1, coalesce(b.n,0) AS n2, a.s AS s1, b.s AS s2, coalesce(a.v,0) AS v1, coalesce(b.v,0) AS v2
  FROM (SELECT * FROM a WHERE frame_id < (SELECT max(frame_id) FROM objects)) a FULL JOIN (SELECT * FROM a WHERE frame_id > (SELECT min(frame_id) FROM objects)) b ON a.scene_id=b.scene_id AND a.label=b.label AND b.frame_id=a.frame_id+1)"""
_SCORED = "scored AS (SELECT *, 0.75*visibility + 0.25*(greatest(0.0,u1-u0)*greatest(0.0,v1-v0)/(640.0*480.0)) - 0.03*CAST(occluded AS INT) - 0.02*CAST(truncated AS INT) AS score FROM objects), " + _TWO


def frame_label_pairs(spark, sf):
    """Counts, scores and visibility of each label in a frame and the next."""
    o = lookup.visible(objects(spark, sf))
    ratio = g.area_ratio([F.col(c) for c in ("u0", "v0", "u1", "v1")])
    o = o.withColumn("score", g.visibility_score(F.col("visibility"), ratio, F.col("occluded"), F.col("truncated")))
    a = o.groupBy("scene_id", "frame_id", "label").agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("s"), F.max("visibility").alias("v"))
    ends = objects(spark, sf).agg(F.min("frame_id").alias("first"), F.max("frame_id").alias("last")).first()
    one = a.where(F.col("frame_id") < ends["last"]).select("scene_id", F.col("frame_id").alias("frame_1"), "label", F.col("n").alias("n1"), F.col("s").alias("s1"), F.col("v").alias("v1"))
    two = a.where(F.col("frame_id") > ends["first"]).select("scene_id", (F.col("frame_id") - 1).alias("frame_1"), "label", F.col("n").alias("n2"), F.col("s").alias("s2"), F.col("v").alias("v2"))
    return one.join(two, ["scene_id", "frame_1", "label"], "full").na.fill(0, ["n1", "n2"]).na.fill(0.0, ["v1", "v2"])


@query("t12_visibility_compare", with_views("objects", rest=_SCORED) + """
SELECT scene_id, frame_1, label, CASE WHEN n1 > 1 OR n2 > 1 THEN NULL WHEN n1 = 0 THEN 'image2' WHEN n2 = 0 THEN 'image1' WHEN abs(s1-s2) <= 0.05 THEN 'same' WHEN s1 > s2 THEN 'image1' ELSE 'image2' END AS answer FROM fp""")
def visibility_compare(spark, sf):
    """In which of two frames a label is seen better; null where it isn't unique."""
    c = F.col
    return frame_label_pairs(spark, sf).select("scene_id", "frame_1", "label", g.compare_visibility(c("s1"), c("s2"), c("n1"), c("n2")).alias("answer"))


@query("u03_pair_unambiguous_labels", with_views("objects", rest=_SCORED) + "SELECT scene_id, frame_1, label, n1, n2 FROM fp WHERE n1 <= 1 AND n2 <= 1 AND n1 + n2 >= 1")
def pair_unambiguous(spark, sf):
    return frame_label_pairs(spark, sf).where("n1 <= 1 AND n2 <= 1 AND n1 + n2 >= 1").select("scene_id", "frame_1", "label", "n1", "n2")


@query("u04_shared_unique_labels", with_views("objects", rest=_SCORED) + "SELECT scene_id, frame_1, label FROM fp WHERE n1 = 1 AND n2 = 1")
def shared_unique(spark, sf):
    u = unique_seen(spark, sf).select("scene_id", "frame_id", "label")
    second = u.select("scene_id", (F.col("frame_id") - 1).alias("frame_1"), "label")
    return u.withColumnRenamed("frame_id", "frame_1").join(second, ["scene_id", "frame_1", "label"])


@query("u05_visibility_contrast", with_views("objects", rest=_SCORED) + """,
c AS (SELECT *, abs(v1-v2) AS delta FROM fp WHERE n1 <= 1 AND n2 <= 1 AND n1 + n2 >= 1 AND abs(v1-v2) >= 0.15)
SELECT scene_id, frame_1, label, round(delta, 6) AS delta, CAST(row_number() OVER (PARTITION BY scene_id, frame_1 ORDER BY delta DESC, greatest(v1,v2) DESC, label) AS INT) AS rank FROM c""")
def visibility_contrast(spark, sf):
    """Unambiguous labels whose visibility differs, the strongest contrast first."""
    from pyspark.sql import Window

    c = frame_label_pairs(spark, sf).where("n1 <= 1 AND n2 <= 1 AND n1 + n2 >= 1").withColumn("delta", F.abs(F.col("v1") - F.col("v2"))).where("delta >= 0.15")
    w = Window.partitionBy("scene_id", "frame_1").orderBy(F.desc("delta"), F.desc(F.greatest("v1", "v2")), "label")
    return c.select("scene_id", "frame_1", "label", F.round("delta", 6).alias("delta"), F.row_number().over(w).alias("rank"))


@query("t13_position_cam_obj", with_views("objects", rest="low AS (SELECT *, count(*) OVER (PARTITION BY scene_id, frame_id, label) AS n FROM objects WHERE visibility >= 0.1)") + f"SELECT scene_id, frame_id, label, {sql_dir8('cx', 'cz')} AS answer FROM low WHERE n = 1")
def position_cam_obj(spark, sf):
    """Direction of each label's single detection from the camera, in (x, z)."""
    u = lookup.unique_objects(lookup.visible(objects(spark, sf), 0.1), "scene_id", "frame_id")
    return u.select("scene_id", "frame_id", "label", g.dir8(F.col("cx"), F.col("cz")).alias("answer"))


@query("t16_attribute_measurement", with_views("objects", rest=FUNIQUE) + """,
s AS (SELECT *, greatest(x1-x0, y1-y0, z1-z0) AS len, (x1-x0)*(y1-y0)*(z1-z0) AS vol FROM uniq)
SELECT a.scene_id, a.frame_id, a.label AS label_1, b.label AS label_2, CASE WHEN a.len >= b.len THEN a.label ELSE b.label END AS answer, round(a.vol, 6) AS volume_1 FROM s a JOIN s b ON a.scene_id=b.scene_id AND a.frame_id=b.frame_id AND a.label<b.label""")
def attribute_measurement(spark, sf):
    """The longer of two visible objects (G16); the first of equals."""
    u = unique_seen(spark, sf)
    d = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]
    u = u.select("scene_id", "frame_id", "label", F.greatest(*d).alias("len"), (d[0] * d[1] * d[2]).alias("vol"))
    p = lookup.pairs(u, "scene_id", "frame_id")
    return p.select("scene_id", "frame_id", "label_1", "label_2", F.when(F.col("len_1") >= F.col("len_2"), F.col("label_1")).otherwise(F.col("label_2")).alias("answer"), F.round("vol_1", 6).alias("volume_1"))


@query("t17_scene_summary", with_views("objects") + """
SELECT scene_id, count(*) AS n_objects, count(DISTINCT label) AS n_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, round(avg(visibility), 6) AS mean_visibility FROM objects GROUP BY scene_id""")
def scene_summary(spark, sf):
    """Totals and labels of each scene, from one row per scene and label."""
    c = objects(spark, sf).groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("visibility").alias("v"))
    return c.groupBy("scene_id").agg(F.sum("n").alias("n_objects"), F.count(F.lit(1)).alias("n_labels"), F.array_join(F.sort_array(F.collect_list("label")), ",").alias("labels"), F.round(F.sum("v") / F.sum("n"), 6).alias("mean_visibility"))


@query("a09_frame_summary", with_views("objects") + "SELECT scene_id, frame_id, count(*) AS n_objects, sum(CASE WHEN visibility >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS n_visible, round(max(visibility),6) AS top FROM objects GROUP BY 1,2")
def frame_summary(spark, sf):
    return objects(spark, sf).groupBy("scene_id", "frame_id").agg(F.count(F.lit(1)).alias("n_objects"), F.count_if(F.col("visibility") >= 0.5).alias("n_visible"), F.round(F.max("visibility"), 6).alias("top"))


@query("a10_multi_image_summary", with_views("objects", rest="""k AS (SELECT DISTINCT scene_id, frame_id, frame_id AS frame_1 FROM objects UNION ALL SELECT DISTINCT scene_id, frame_id, frame_id - 1 FROM objects),
  f AS (SELECT k.scene_id, k.frame_1, label, count(DISTINCT o.frame_id) AS nf, count(*) AS n FROM k JOIN objects o ON o.scene_id = k.scene_id AND o.frame_id = k.frame_id GROUP BY 1,2,3),
  two AS (SELECT scene_id, frame_1 FROM k GROUP BY 1,2 HAVING count(*) = 2)""") + """
SELECT f.scene_id, f.frame_1, string_agg(label, ',' ORDER BY label) AS union_labels, coalesce(string_agg(CASE WHEN nf = 2 THEN label END, ',' ORDER BY label), '') AS shared_labels, sum(n)::BIGINT AS n
FROM f JOIN two ON two.scene_id = f.scene_id AND two.frame_1 = f.frame_1 GROUP BY 1,2""")
def multi_image_summary(spark, sf):
    """Union and intersection of the labels of each frame and the next, and summed counts."""
    o = objects(spark, sf).groupBy("scene_id", "frame_id", "label").agg(F.count(F.lit(1)).alias("n"))
    both = o.withColumn("frame_1", F.explode(F.array("frame_id", F.col("frame_id") - 1)))
    f = both.groupBy("scene_id", "frame_1", "label").agg(F.count(F.lit(1)).alias("nf"), F.sum("n").alias("n"), F.min("frame_id").alias("low"), F.max("frame_id").alias("high"))
    names = lambda c: F.array_join(F.sort_array(F.collect_list(c)), ",")
    out = f.groupBy("scene_id", "frame_1").agg(names(F.col("label")).alias("union_labels"), names(F.when(F.col("nf") == 2, F.col("label"))).alias("shared_labels"), F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    return out.where("low < high").drop("low", "high")


_FEASIBLE = """c AS (SELECT scene_id, label, count(*) AS n FROM objects GROUP BY 1,2), k AS (SELECT scene_id, count(*) FILTER (n = 1) AS u, count(*) FILTER (n > 1) AS m FROM c GROUP BY 1),
fc AS (SELECT scene_id, frame_id, label, count(*) AS n FROM objects WHERE visibility >= 0.5 GROUP BY 1,2,3), fk AS (SELECT scene_id, frame_id, count(*) FILTER (n = 1) AS u, count(*) AS l FROM fc GROUP BY 1,2)"""


@query("t18_feasible_tasks", with_views("objects", rest=_FEASIBLE) + """
SELECT scene_id, -1 AS frame_id, concat_ws(',', CASE WHEN m >= 1 THEN 'object_counting' END, CASE WHEN u >= 2 THEN 'absolute_distance' END, CASE WHEN u >= 1 THEN 'object_size' END, 'room_size', CASE WHEN u >= 4 THEN 'relative_distance' END, CASE WHEN u >= 3 THEN 'relative_direction_hard' END) AS tasks FROM k
UNION ALL SELECT scene_id, frame_id, concat_ws(',', CASE WHEN u >= 2 THEN 'single_image_relative_direction' END, CASE WHEN u >= 1 THEN 'distance_cam_obj' END, CASE WHEN u >= 2 THEN 'depth_order_obj_obj' END) FROM fk""")
def feasible_tasks(spark, sf):
    """The tasks that a scene's, or a frame's, unique and repeated labels allow; frame -1 stands for the scene."""
    count = lambda o, *keys: o.groupBy(*keys, "label").count().groupBy(*keys).agg(F.count_if(F.col("count") == 1).alias("u"), F.count_if(F.col("count") > 1).alias("m"))
    named = lambda rules: F.concat_ws(",", *[F.when(F.expr(rule), name) for name, rule in rules]).alias("tasks")
    scene = [("object_counting", "m >= 1"), ("absolute_distance", "u >= 2"), ("object_size", "u >= 1"), ("room_size", "true"), ("relative_distance", "u >= 4"), ("relative_direction_hard", "u >= 3")]
    frame = [("single_image_relative_direction", "u >= 2"), ("distance_cam_obj", "u >= 1"), ("depth_order_obj_obj", "u >= 2")]
    o = objects(spark, sf)
    one = count(o, "scene_id").select("scene_id", F.lit(-1).cast("long").alias("frame_id"), named(scene))
    return one.unionByName(count(lookup.visible(o), "scene_id", "frame_id").select("scene_id", "frame_id", named(frame)))


@query("a04_label_annotation", with_views("objects", rest=UNIQUE) + "SELECT DISTINCT scene_id, concat(label, CASE WHEN n = 1 THEN ' (Unique)' ELSE ' (Non-Unique)' END) AS annotated, n AS label_count FROM counted")
def label_annotation(spark, sf):
    c = objects(spark, sf).groupBy("scene_id", "label").agg(F.count(F.lit(1)).alias("label_count"))
    return c.select("scene_id", F.concat("label", F.when(F.col("label_count") == 1, " (Unique)").otherwise(" (Non-Unique)")).alias("annotated"), "label_count")


@query("a05_label_pools", with_views("objects", rest="c AS (SELECT scene_id, label, count(*) AS n FROM objects GROUP BY 1,2)") + "SELECT scene_id, coalesce(string_agg(CASE WHEN n=1 THEN label END, ',' ORDER BY label),'') AS unique_labels, coalesce(string_agg(CASE WHEN n>1 THEN label END, ',' ORDER BY label),'') AS repeated_labels FROM c GROUP BY scene_id")
def label_pools(spark, sf):
    c = objects(spark, sf).groupBy("scene_id", "label").count()
    pool = lambda test: F.array_join(F.sort_array(F.collect_list(F.when(test, F.col("label")))), ",")
    return c.groupBy("scene_id").agg(pool(F.col("count") == 1).alias("unique_labels"), pool(F.col("count") > 1).alias("repeated_labels"))


@query("a02_visible_anchor_counts", with_views("objects") + "SELECT scene_id, frame_id, label, count(*) AS n, round(max(visibility),6) AS top FROM objects WHERE visibility >= 0.5 AND label NOT IN ('wall','otherprop','ceiling','otherfurniture') GROUP BY 1,2,3")
def visible_anchor_counts(spark, sf):
    """A2 and A7 over P1 and P4: visible anchors of each frame, and how well they are seen."""
    return lookup.anchors(lookup.visible(objects(spark, sf))).groupBy("scene_id", "frame_id", "label").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("visibility"), 6).alias("top"))


@query("a06_distinct_instances", with_views("objects") + """SELECT scene_id, label, count(DISTINCT CASE WHEN object_id % 3 <> 0 THEN {'k': 0, 'a': CAST(object_id AS DOUBLE), 'b': 0.0::DOUBLE, 'c': 0.0::DOUBLE}
  WHEN object_id % 7 <> 0 THEN {'k': 1, 'a': round(floor(x), 4) + 0.0::DOUBLE, 'b': round(floor(y), 4) + 0.0::DOUBLE, 'c': round(floor(z), 4) + 0.0::DOUBLE}
  ELSE {'k': 2, 'a': CAST(frame_id AS DOUBLE), 'b': CAST(object_id AS DOUBLE), 'c': 0.0::DOUBLE} END) AS instances
FROM objects WHERE label NOT IN ('wall','otherprop','ceiling','otherfurniture') GROUP BY 1,2""")
def distinct_instances(spark, sf):
    """Instances of each usable label over frames: by id where there is one, else by place, else by frame and position.

    Every third object has no id here, every 21st no place either; places are on a grid, so that some are shared.
    """
    o = lookup.anchors(objects(spark, sf)).withColumns({"id": F.when(F.col("object_id") % 3 != 0, F.col("object_id")), "placed": F.col("object_id") % 7 != 0})
    place = F.when(F.col("placed"), F.array(*[F.floor(c).cast("double") for c in "xyz"]))
    return o.groupBy("scene_id", "label").agg(F.countDistinct(lookup.instance_key(F.col("id"), place, F.col("frame_id"), F.col("object_id"))).alias("instances"))


@query("a12_boxes", with_views("objects") + "SELECT scene_id, label, round(min(x0),4)+0.0 AS x0, round(max(x1),4)+0.0 AS x1, round((min(y0)+max(y1))/2,4)+0.0 AS yc, round(100*greatest(max(x1)-min(x0),max(y1)-min(y0),max(z1)-min(z0)),2) AS size_cm FROM objects GROUP BY 1,2")
def boxes(spark, sf):
    """Bounds, centre and longest side of what shares a label."""
    span = lambda a: F.max(f"{a}1") - F.min(f"{a}0")
    return objects(spark, sf).groupBy("scene_id", "label").agg(
        g.tidy(F.min("x0"), 4).alias("x0"), g.tidy(F.max("x1"), 4).alias("x1"), g.tidy((F.min("y0") + F.max("y1")) / 2, 4).alias("yc"), F.round(100 * F.greatest(span("x"), span("y"), span("z")), 2).alias("size_cm")
    )


@query("a13_pixel_boxes", with_views("objects") + """SELECT scene_id, frame_id, label, least(640, greatest(0, CAST(trunc(min(u0)) AS BIGINT) - 2)) AS u0, least(480, greatest(0, CAST(trunc(min(v0)) AS BIGINT) - 2)) AS v0,
  least(640, CAST(trunc(max(u1) + 0.5) AS BIGINT) + 2) AS u1, least(480, CAST(trunc(max(v1) + 0.5) AS BIGINT) + 2) AS v1 FROM objects GROUP BY 1,2,3""")
def pixel_boxes(spark, sf):
    """Pixel bounds with a margin of two, the upper ones rounded, clamped to the image of 640 by 480."""
    low = lambda c, most: F.least(F.lit(most), F.greatest(F.lit(0), F.min(c).cast("long") - 2)).cast("long")
    high = lambda c, most: F.least(F.lit(most), (F.max(c) + 0.5).cast("long") + 2).cast("long")
    return objects(spark, sf).groupBy("scene_id", "frame_id", "label").agg(low("u0", 640).alias("u0"), low("v0", 480).alias("v0"), high("u1", 640).alias("u1"), high("v1", 480).alias("v1"))


@query("a14_visibility_ratio", with_views("objects") + "SELECT scene_id, label, round(avg(CASE WHEN visibility >= 0.5 THEN 1.0 ELSE 0.0 END), 4) AS ratio, " + ", ".join(f"coalesce(round((min(c{c}) FILTER (visibility >= 0.5) + max(c{c}) FILTER (visibility >= 0.5))/2, 4), -1.0) + 0.0 AS centre_{c}" for c in "xyz") + " FROM objects GROUP BY 1,2")
def visibility_ratio(spark, sf):
    """Share of visible points and the middle of the visible ones' bounds, -1 in all three coordinates where none is."""
    seen = lambda c: F.when(F.col("visibility") >= 0.5, F.col(f"c{c}"))
    middle = lambda c: (F.coalesce(F.round((F.min(seen(c)) + F.max(seen(c))) / 2, 4), F.lit(-1.0)) + 0.0).alias(f"centre_{c}")
    return objects(spark, sf).groupBy("scene_id", "label").agg(F.round(F.avg(F.when(F.col("visibility") >= 0.5, 1.0).otherwise(0.0)), 4).alias("ratio"), *[middle(c) for c in "xyz"])


_SHOTS = "shots AS (SELECT scene_id, label, visibility, vec_frame, dense_rank() OVER (PARTITION BY scene_id ORDER BY vec_frame) - 1 AS i FROM (SELECT *, CAST(floor(object_id / 20) AS BIGINT) AS vec_frame FROM objects))"


@query("a15_first_frame", with_views("objects", rest=_SHOTS) + "SELECT scene_id, label, coalesce(CAST(min(vec_frame) FILTER (visibility >= 0.1 AND i % 20 = 0) AS VARCHAR), '-1') AS first_frame FROM shots GROUP BY 1,2")
def first_frame(spark, sf):
    """Of every 20th frame of a scene the first where a label is seen, -1 where it never is."""
    from pyspark.sql import Window

    o = objects(spark, sf).withColumn("shot", F.floor(F.col("object_id") / 20))
    frames = o.select("scene_id", "shot").distinct()
    kept = frames.withColumn("i", F.row_number().over(Window.partitionBy("scene_id").orderBy("shot")) - 1).where("i % 20 = 0").select("scene_id", "shot", F.lit(True).alias("kept"))
    o = o.join(kept, ["scene_id", "shot"], "left")
    seen = F.when((F.col("visibility") >= 0.1) & F.col("kept"), F.col("shot"))
    return o.groupBy("scene_id", "label").agg(F.coalesce(F.min(seen).cast("string"), F.lit("-1")).alias("first_frame"))


@query("a16_floor_percentile", with_views("objects", rest="q AS (SELECT scene_id, quantile_cont(z, 0.4) AS p40 FROM objects GROUP BY 1)") + "SELECT o.scene_id, round(any_value(p40), 6) + 0.0 AS p40, count(*) FILTER (z < p40 + 0.1) AS n_floor FROM objects o JOIN q ON o.scene_id = q.scene_id GROUP BY o.scene_id")
def floor_percentile(spark, sf):
    """The exact 40th percentile of height, and the points below it and a margin."""
    o = objects(spark, sf)
    q = percentile(o, ["scene_id"], F.col("z"), 0.4, "p40").select("scene_id", "p40")
    return o.join(q, "scene_id").groupBy("scene_id").agg(g.tidy(F.first("p40")).alias("p40"), F.count_if(F.col("z") < F.col("p40") + 0.1).alias("n_floor"))


@query("a16_hot_percentile", "SELECT l_linestatus, count(*) AS n, round(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.4), 4) AS p40 FROM lineitem GROUP BY 1")
def hot_percentile(spark, sf):
    """A16 of groups that hold half of all rows each."""
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return percentile(rows, ["l_linestatus"], F.col("l_extendedprice"), 0.4, "p40").select("l_linestatus", "n", F.round("p40", 4).alias("p40"))


@query("a17_voxels", with_views("objects", rest="b AS (SELECT scene_id, min(x) AS mx, min(y) AS my, min(z) AS mz FROM objects GROUP BY 1)") + "SELECT o.scene_id, CAST(floor((x-mx)/1.0) AS BIGINT) AS i, CAST(floor((y-my)/1.0) AS BIGINT) AS j, CAST(floor((z-mz)/1.0) AS BIGINT) AS k, min(object_id) AS first_object FROM objects o JOIN b ON o.scene_id=b.scene_id GROUP BY 1,2,3,4")
def voxels(spark, sf):
    """The first point of every voxel of one metre."""
    o = objects(spark, sf)
    b = o.groupBy("scene_id").agg(*[F.min(c).alias(f"m{c}") for c in "xyz"])
    cells = [F.floor((F.col(c) - F.col(f"m{c}")) / 1.0).alias(k) for c, k in zip("xyz", "ijk", strict=True)]
    return o.join(b, "scene_id").groupBy("scene_id", *cells).agg(F.min("object_id").alias("first_object"))


@query("j12_detection_merge", with_views("objects", rest=FUNIQUE + ", fr AS (SELECT DISTINCT scene_id, frame_id FROM objects)") + """SELECT scene_id, frame_id, object_id, label, 'frame' AS origin FROM seen UNION ALL
SELECT o.scene_id, fr.frame_id, object_id, label, 'scene' AS origin FROM objects o JOIN fr ON fr.scene_id = o.scene_id WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.frame_id = fr.frame_id AND s.object_id = o.object_id AND s.scene_id = o.scene_id)""")
def detection_merge(spark, sf):
    """Each frame's detections and the scene objects that are not among them."""
    o = objects(spark, sf).select("scene_id", "object_id", "label")
    seen = lookup.visible(objects(spark, sf)).select("scene_id", "frame_id", "object_id", "label")
    every = o.join(objects(spark, sf).select("scene_id", "frame_id").distinct(), "scene_id")
    rest = every.join(seen, ["scene_id", "frame_id", "object_id"], "left_anti").select("scene_id", "frame_id", "object_id", "label")
    return seen.withColumn("origin", F.lit("frame")).unionByName(rest.withColumn("origin", F.lit("scene")))


@query("j17_key_mismatch", with_views("objects", "poses", rest="a AS (SELECT DISTINCT scene_id, frame_id FROM objects), b AS (SELECT DISTINCT scene_id, CAST(frame_id AS BIGINT) AS frame_id FROM poses)") + "SELECT coalesce(a.scene_id,b.scene_id) AS scene_id, coalesce(a.frame_id,b.frame_id) AS frame_id, CASE WHEN a.scene_id IS NULL THEN 'second' ELSE 'first' END AS only_in FROM a FULL JOIN b ON a.scene_id=b.scene_id AND a.frame_id=b.frame_id WHERE a.scene_id IS NULL OR b.scene_id IS NULL")
def key_mismatch(spark, sf):
    """Frames that have objects or a pose but not both."""
    poses = spark_view(spark, sf, "poses").withColumn("frame_id", F.col("frame_id").cast("long"))
    return lookup.key_mismatches(objects(spark, sf), poses, "scene_id", "frame_id")


@query("j19_object_frames", with_views("objects", "poses") + "SELECT p.scene_id, p.frame_id, count(*) AS n FROM poses p JOIN objects o ON o.scene_id = p.scene_id GROUP BY 1,2")
def object_frames(spark, sf):
    """Every object against every frame of its scene."""
    return lookup.matches(spark_view(spark, sf, "poses"), objects(spark, sf), "scene_id", "frame_id")


@query("g12_visibility_scores", with_views("objects", rest=_SCORED) + "SELECT object_id, round(score, 6) + 0.0 AS score FROM scored")
def visibility_scores(spark, sf):
    """G12 and G29."""
    ratio = g.area_ratio([F.col(c) for c in ("u0", "v0", "u1", "v1")])
    return objects(spark, sf).select("object_id", g.tidy(g.visibility_score(F.col("visibility"), ratio, F.col("occluded"), F.col("truncated"))).alias("score"))


@query("g06_direction_modes", with_views("objects") + """SELECT object_id, CASE WHEN abs(x) > abs(y) THEN CASE WHEN x > 0 THEN 'right' ELSE 'left' END ELSE CASE WHEN y > 0 THEN 'front' ELSE 'back' END END AS four,
  CASE WHEN abs(cx) >= abs(cy) AND abs(cx) >= abs(cz) THEN CASE WHEN cx > 0 THEN 'right' ELSE 'left' END WHEN abs(cz) >= abs(cy) THEN CASE WHEN cz > 0 THEN 'front' ELSE 'back' END ELSE CASE WHEN cy < 0 THEN 'up' ELSE 'down' END END AS six,
  CASE WHEN abs(z) > 0.5*sqrt(x*x+y*y) THEN CASE WHEN z > 0 THEN 'up' ELSE 'down' END ELSE """ + sql_dir8("x", "y") + " END AS detailed FROM objects")
def direction_modes(spark, sf):
    """The four-way, six-way and detailed forms."""
    c = F.col
    return objects(spark, sf).select("object_id", g.dir4(c("x"), c("y")).alias("four"), g.dir6(c("cx"), c("cy"), c("cz")).alias("six"), g.detailed_direction(c("x"), c("y"), c("z")).alias("detailed"))


@query("g24_rotations", with_views("poses", rest=_ROT) + "SELECT scene_id, frame_id, " + ", ".join(f"round(r{i}, 6) + 0.0 AS r{i}" for i in range(9)) + ", CASE WHEN -r7 >= -r6 AND -r7 >= r7 AND -r7 >= r6 THEN 'Up' WHEN -r6 >= r7 AND -r6 >= r6 THEN 'Left' WHEN r7 >= r6 THEN 'Down' ELSE 'Right' END AS sky FROM cam")
def rotations(spark, sf):
    """Rotations by angle-axis vectors, and which side of the image is up."""
    c = cameras(spark, sf)
    return c.select("scene_id", "frame_id", *[g.tidy(F.col(f"r{i}")).alias(f"r{i}") for i in range(9)], g.sky_direction(F.col("r6"), F.col("r7")).alias("sky"))


@query("g28_projection", with_views("objects", "poses", rest=_ROT) + """,
l AS (SELECT o.object_id, c.frame_id, c.r0*(x-tx)+c.r3*(y-ty)+c.r6*(z-tz) AS lx, c.r1*(x-tx)+c.r4*(y-ty)+c.r7*(z-tz) AS ly, c.r2*(x-tx)+c.r5*(y-ty)+c.r8*(z-tz) AS lz FROM objects o JOIN cam c ON o.scene_id=c.scene_id),
p AS (SELECT *, 525.0*lx/lz+320.0 AS u, 525.0*ly/lz+240.0 AS v FROM l WHERE lz > 0)
SELECT object_id, frame_id, round(u,3)+0.0 AS u, round(v,3)+0.0 AS v, (lz-2.0)/(2.0+1e-6) > 0.001 AS hidden, round((u-320.0)*lz/525.0, 4)+0.0 AS back_x FROM p WHERE u >= 0 AND u < 640 AND v >= 0 AND v < 480""")
def projection(spark, sf):
    """Points in view, hidden behind a depth of two metres, and back again."""
    p = objects(spark, sf).select("scene_id", "object_id", "x", "y", "z").join(cameras(spark, sf), "scene_id")
    local = g.to_camera(g.col3(""), [F.col(f"r{i}") for i in range(9)], g.col3("t"))
    p = p.withColumns({"lx": local[0], "ly": local[1], "lz": local[2]})
    k = [F.lit(525.0), F.lit(525.0), F.lit(320.0), F.lit(240.0)]
    u, v = g.project([F.col("lx"), F.col("ly"), F.col("lz")], *k)
    p = p.withColumns({"u": u, "v": v}).where("u >= 0 AND u < 640 AND v >= 0 AND v < 480")
    back = g.back_project(F.col("u"), F.col("v"), F.col("lz"), *k)
    return p.select("object_id", "frame_id", g.tidy(F.col("u"), 3).alias("u"), g.tidy(F.col("v"), 3).alias("v"), g.occluded(F.col("lz"), F.lit(2.0)).alias("hidden"), g.tidy(back[0], 4).alias("back_x"))


@query("g26_box_corners", with_views("objects") + "SELECT object_id, round(x + sx*(x1-x0)/2, 4) + 0.0 AS px, round(y + sy*(y1-y0)/2, 4) + 0.0 AS py, round(z + sz*(z1-z0)/2, 4) + 0.0 AS pz FROM objects, (VALUES (-1.0),(1.0)) a(sx), (VALUES (-1.0),(1.0)) b(sy), (VALUES (-1.0),(1.0)) c(sz)")
def box_corners(spark, sf):
    half = [(F.col(f"{c}1") - F.col(f"{c}0")) / 2 for c in "xyz"]
    o = objects(spark, sf).select("object_id", F.explode(g.box_corners(g.col3(""), half)).alias("p"))
    return o.select("object_id", *[g.tidy(F.col(f"p.{c}"), 4).alias(f"p{c}") for c in "xyz"])


@query("o06_recovery_evidence", with_views("objects", rest="r AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY CASE WHEN label = 'l3' THEN 0 ELSE 1 END, label, CAST(object_id AS VARCHAR)) AS k FROM objects)") + "SELECT scene_id, object_id, label, CAST(k AS INT) AS k FROM r WHERE k <= 5")
def recovery_evidence(spark, sf):
    """The scene's objects shown for a question that failed: relevant ones first, then by label and id as text."""
    return lookup.evidence(objects(spark, sf), ["scene_id"], ["l3"], 5, F.col("label"), F.col("object_id").cast("string")).select("scene_id", "object_id", "label", "k")


@query("o07_frame_evidence", with_views("objects", rest="r AS (SELECT *, row_number() OVER (PARTITION BY scene_id, frame_id ORDER BY CASE WHEN label IN ('l3', 'l5') THEN 0 ELSE 1 END, visibility DESC, CAST(object_id AS VARCHAR)) AS k FROM objects)") + "SELECT scene_id, frame_id, object_id, label, CAST(k AS INT) AS k FROM r WHERE k <= 3")
def frame_evidence(spark, sf):
    """A frame's objects: relevant ones first, then the best seen, then by id as text."""
    return lookup.evidence(objects(spark, sf), ["scene_id", "frame_id"], ["l3", "l5"], 3, F.desc("visibility"), F.col("object_id").cast("string")).select("scene_id", "frame_id", "object_id", "label", "k")


@query("g17_aligned_poses", with_views("poses", rest=_ROT) + """,
al AS (SELECT scene_id, cos(min(tx)) AS c, sin(min(tx)) AS s, min(ty) AS ay, max(tz) AS az FROM poses GROUP BY 1)
SELECT cam.scene_id, frame_id, round(c*r0 - s*r3, 6) + 0.0 AS r0, round(s*r0 + c*r3, 6) + 0.0 AS r3, round(r8, 6) + 0.0 AS r8, round(c*tx - s*ty + ay, 6) + 0.0 AS tx, round(s*tx + c*ty, 6) + 0.0 AS ty, round(tz + az, 6) + 0.0 AS tz FROM cam JOIN al ON al.scene_id = cam.scene_id""")
def aligned_poses(spark, sf):
    """Every pose behind its scene's alignment, a turn about the height and a shift, as products of 4x4 matrices."""
    lit = F.lit
    al = spark_view(spark, sf, "poses").groupBy("scene_id").agg(F.cos(F.min("tx")).alias("c"), F.sin(F.min("tx")).alias("s"), F.min("ty").alias("ay"), F.max("tz").alias("az"))
    p = cameras(spark, sf).join(al, "scene_id")
    c, s = F.col("c"), F.col("s")
    zero, one = lit(0.0), lit(1.0)
    a = [c, -s, zero, F.col("ay"), s, c, zero, zero, zero, zero, one, F.col("az"), zero, zero, zero, one]
    b = [x for i in range(3) for x in [*[F.col(f"r{3 * i + j}") for j in range(3)], F.col("t" + "xyz"[i])]] + [zero, zero, zero, one]
    m = g.matrix_product(a, b)
    return p.select("scene_id", "frame_id", *[g.tidy(m[i]).alias(n) for i, n in ((0, "r0"), (4, "r3"), (10, "r8"), (3, "tx"), (7, "ty"), (11, "tz"))])
