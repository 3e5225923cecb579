"""Frame queries: embeddings read as 8x8 gray pictures, one per second of a video per label."""

from __future__ import annotations

from pyspark.sql import functions as F

from lectern.functions import ordered
from lectern.operators import frames as op
from lectern.plans.inputs import DUCK, NEEDS, frame, with_inputs
from lectern.plans.registry import Registry
from lectern.sources import readers

REG = Registry()

SMALL = op.Timeline(cell=2, ink_radius=1, plate_half=2, hold=2, erase_lag=2, min_seg=2, pre=2, post=4,
                    min_content=0.001, max_motion=0.95, slice_seconds=16)

_PX = "least(255, greatest(0, CAST(floor((CAST(x AS DOUBLE) + 0.5) * 255) AS INT)))"
DUCK["frames"] = f"""
    SELECT CAST(label AS BIGINT) AS video_id, CAST(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS INT) AS t,
           CAST(list_transform(embedding, lambda x: {_PX}) AS INT[]) AS px FROM embeddings"""
_PIX = """,
    pix AS (SELECT video_id, t, unnest(px) AS v, generate_subscripts(px, 1) - 1 AS i FROM frames)"""
# A 17x16 grid over all 64 pixels; hashes are four words.
_CELL = "({row} // 2) * 8 + ({col} * 8) // 17 + 1"
_HASH = with_inputs("frames") + _PIX + f""",
    words AS (SELECT video_id, t, i // 64 AS k, sum(CASE WHEN px[{_CELL.format(row='(i // 16)', col='(i % 16)')}] > px[{_CELL.format(row='(i // 16)', col='(i % 16 + 1)')}]
                THEN 1::HUGEINT << CAST(63 - i % 64 AS INT) ELSE 0 END) AS w FROM frames, range(0, 256) r(i) GROUP BY ALL),
    hs AS (SELECT video_id, t, list(CAST(CASE WHEN w >= 9223372036854775808 THEN w - 18446744073709551616 ELSE w END AS BIGINT) ORDER BY k) AS hash FROM words GROUP BY ALL)"""


def gray(t):
    numbered = ordered.row_numbers(t.embeddings, ["label"], "vec_id", "n", F.floor(F.col("vec_id") / 65536))
    return numbered.select(
        F.col("label").cast("bigint").alias("video_id"), (F.col("n") - 1).alias("t"), F.lit(8).alias("w"), F.lit(8).alias("h"),
        F.expr(f"transform(embedding, x -> {_PX})").alias("px"))


def hashed(pictures):
    """All 64 pixels spread over the 17x16 grid of a 256-bit hash."""
    grid = "transform(sequence(0, 271), i -> px[(i div 17) div 2 * 8 + (i % 17 * 8) div 17])"
    return op.frame_dhash(pictures.withColumn("grid", F.expr(grid)), 16).drop("grid")


_LAP = _HASH + """,
    lap AS (SELECT c.video_id, c.t, u.v + d.v + l.v + r.v - 4 * c.v AS x FROM pix c JOIN pix u ON u.video_id = c.video_id AND u.t = c.t AND u.i = c.i - 8
            JOIN pix d ON d.video_id = c.video_id AND d.t = c.t AND d.i = c.i + 8 JOIN pix l ON l.video_id = c.video_id AND l.t = c.t AND l.i = c.i - 1
            JOIN pix r ON r.video_id = c.video_id AND r.t = c.t AND r.i = c.i + 1 WHERE c.i % 8 BETWEEN 1 AND 6 AND c.i BETWEEN 8 AND 55),
    sh AS (SELECT video_id, t, CAST(36 * sum(x * x) - sum(x) * sum(x) AS DOUBLE) / 1296 AS sharpness FROM lap GROUP BY ALL),
    qc AS (SELECT sh.*, CASE WHEN (SELECT count(*) FROM pix p WHERE p.video_id = sh.video_id AND p.t = sh.t AND v < 25) / 64 > 0.97 THEN 'dark'
              WHEN (SELECT count(*) FROM pix p WHERE p.video_id = sh.video_id AND p.t = sh.t AND v >= 250) / 64 > 0.985 THEN 'bright' WHEN sharpness < 10 THEN 'blurry' ELSE 'ok' END AS qc FROM sh)"""


@REG.query("frame_qc", _LAP + " SELECT video_id, t, qc, sharpness FROM qc")
def _(t):
    return op.frame_qc(gray(t)).select("video_id", "t", "qc", "sharpness")


@REG.query("frame_sharpness", _LAP + " SELECT video_id, t, sharpness FROM sh")
def _(t):
    return op.frame_qc(gray(t)).select("video_id", "t", "sharpness")


@REG.query("frame_dhash", _HASH + " SELECT video_id, t, list_aggregate(hash, 'string_agg', ' ') AS hash FROM hs")
def _(t):
    return hashed(gray(t)).select("video_id", "t", F.array_join(F.col("hash").cast("array<string>"), " ").alias("hash"))


# Frames stand in fours: the later three repeat the first one but for a few pixels of their own, more or fewer by
# time, so that pages hold many different hashes near each other, and far ones.
_OWN = "(i * 7 + t) % (5 + t % 4 * 7) = 0"


def _pool(t):
    frames = gray(t)
    base = frames.filter("t % 4 = 0").select("video_id", F.col("t").alias("t0"), F.col("px").alias("base"))
    varied = frames.withColumn("t0", F.expr("t - t % 4")).join(base, ["video_id", "t0"]).withColumn(
        "px", F.expr(f"transform(px, (x, i) -> IF(t % 4 = 0 OR NOT {_OWN}, base[i], x))"))
    return hashed(varied).select("video_id", "t", F.expr("CAST(floor(t / 12) AS INT)").alias("page"), "hash",
                                 F.expr("transform(px, x -> CAST(floor(x / 64) * 3 AS INT))").alias("thumb"))


_POOL = _HASH.replace("WITH ", "WITH RECURSIVE ", 1).replace("frames AS", "whole AS", 1) .replace(_PIX, f""",
    frames AS (SELECT a.video_id, a.t, list_transform(range(0, 64), lambda i: CASE WHEN a.t % 4 = 0 OR NOT {_OWN.replace('t ', 'a.t ').replace('t)', 'a.t)')} THEN b.px[i + 1] ELSE a.px[i + 1] END) AS px
               FROM whole a JOIN whole b ON b.video_id = a.video_id AND b.t = a.t - a.t % 4)""", 1) + """,
    pl AS (SELECT f.video_id, f.t, CAST(floor(f.t / 12) AS INT) AS page, hs.hash AS hash, list_transform(px, lambda x: CAST(floor(x / 64) * 3 AS INT)) AS thumb
           FROM frames f JOIN hs ON hs.video_id = f.video_id AND hs.t = f.t),
    ed AS MATERIALIZED (SELECT a.video_id, a.page, a.t AS early, b.t AS late FROM pl a JOIN pl b ON a.video_id = b.video_id AND a.page = b.page AND a.t < b.t
           WHERE list_sum(list_transform(range(1, 5), lambda i: bit_count(xor(a.hash[i], b.hash[i])))) <= 16
             AND list_sum(list_transform(range(1, 65), lambda i: abs(a.thumb[i] - b.thumb[i]))) / 64.0 < 3),
    st AS MATERIALIZED (SELECT video_id, page, t, row_number() OVER (PARTITION BY video_id, page ORDER BY t) AS i FROM pl),
    rec AS (SELECT video_id, page, i, t, [t] AS kept, CAST(NULL AS INT) AS dup FROM st WHERE i = 1
            UNION ALL
            SELECT s.video_id, s.page, s.i, s.t,
                   CASE WHEN (SELECT min(early) FROM ed WHERE ed.video_id = s.video_id AND ed.page = s.page AND late = s.t AND list_contains(r.kept, early)) IS NULL THEN list_append(r.kept, s.t) ELSE r.kept END,
                   (SELECT min(early) FROM ed WHERE ed.video_id = s.video_id AND ed.page = s.page AND late = s.t AND list_contains(r.kept, early))
            FROM rec r JOIN st s ON s.video_id = r.video_id AND s.page = r.page AND s.i = r.i + 1)"""


@REG.query("near_duplicate_frames", _POOL + " SELECT video_id, page, t AS ord, dup AS duplicate_of FROM rec")
def _(t):
    return op.near_duplicate_frames(_pool(t).withColumnRenamed("t", "ord"), bits=256)


@REG.query("dedupe_keep_later")
def _(t):
    return op.dedupe_keep_later(_pool(t).withColumnRenamed("page", "shot"))


@REG.query("pick_best_frame", _LAP + """,
    nb AS (SELECT a.video_id, a.t, min(d) AS d FROM frames a JOIN (SELECT x.video_id, x.t, CAST(list_sum(list_transform(range(1, 65), lambda i: abs(x.px[i] - y.px[i]))) AS DOUBLE) / 64 AS d
             FROM frames x JOIN frames y ON y.video_id = x.video_id AND abs(y.t - x.t) = 1 AND floor(y.t / 3) = floor(x.t / 3)) z ON z.video_id = a.video_id AND z.t = a.t GROUP BY ALL),
    rk AS (SELECT qc.*, CAST(floor(qc.t / 3) AS INT) AS shot, row_number() OVER (PARTITION BY qc.video_id, floor(qc.t / 3) ORDER BY CASE qc WHEN 'ok' THEN 0 ELSE 1 END, round_even(coalesce(d, 0), 0), -sharpness, qc.t) AS n
           FROM qc LEFT JOIN nb ON nb.video_id = qc.video_id AND nb.t = qc.t)
    SELECT video_id, shot, t AS ord, t, qc FROM rk WHERE n = 1""")
def _(t):
    rows = op.frame_qc(gray(t)).selectExpr("video_id", "CAST(floor(t / 3) AS INT) AS shot", "t AS ord", "t", "qc", "sharpness", "px AS thumb")
    return op.pick_best_frame(rows)


def _cells(t):
    return op.frame_cells(gray(t), SMALL)


def _binary(t):
    """The same pictures as files of a gray format with a header, decoded to one byte per pixel."""
    pixels = F.expr("unhex(array_join(transform(px, v -> lpad(hex(v), 2, '0')), ''))")
    header = F.encode(F.concat(F.lit("P5\n# "), F.col("t").cast("string"), F.lit("\n8 8\n255\n")), "UTF-8")
    files = gray(t).select("video_id", "t", F.concat(header, pixels).alias("content"))
    return readers.decode_gray(files)


def _timeline(t):
    return op.content_timeline(op.persistent_content(_cells(t), SMALL), SMALL)


# The same timeline in SQL: windows by time over 64 pixels, 16 cells of two by two.
_T = SMALL
_TIMELINE = with_inputs("frames", recursive=True) + _PIX + f""",
    plate AS MATERIALIZED (SELECT a.video_id, a.t, a.i, any_value(a.v) AS v, CAST(floor(median(b.v)) AS INT) AS m FROM pix a JOIN pix b ON b.video_id = a.video_id AND b.i = a.i AND b.t BETWEEN a.t - {_T.plate_half} AND a.t + {_T.plate_half} GROUP BY ALL),
    around AS (SELECT a.video_id, a.t, a.i, any_value(a.v) AS v, any_value(a.m) AS m, avg(b.m) AS mean FROM plate a, range(-{_T.ink_radius}, {_T.ink_radius} + 1) y(dy), range(-{_T.ink_radius}, {_T.ink_radius} + 1) x(dx)
               JOIN plate b ON b.video_id = a.video_id AND b.t = a.t AND b.i = least(7, greatest(0, a.i // 8 + dy)) * 8 + least(7, greatest(0, a.i % 8 + dx)) GROUP BY a.video_id, a.t, a.i),
    px2 AS (SELECT r.*, coalesce(abs(r.v - p.v), 0) AS change, CAST(r.i // 16 * 4 + r.i % 8 // 2 AS INT) AS cell FROM around r LEFT JOIN pix p ON p.video_id = r.video_id AND p.t = r.t - 1 AND p.i = r.i),
    fc AS MATERIALIZED (SELECT video_id, t, cell, count(*) FILTER (abs(m - mean) > {_T.ink_diff}) / 4 AS density, count(*) FILTER (abs(v - m) > {_T.occ_diff}) / 4 AS occ,
                 CASE WHEN count(*) FILTER (change > {_T.motion_diff}) / 4 >= {_T.motion_cell} THEN 1 ELSE 0 END AS moving FROM px2 GROUP BY ALL),
    bg AS (SELECT video_id, t, count(*) FILTER (change > {_T.cut_diff}) / 64 AS big FROM px2 GROUP BY ALL),
    cells AS MATERIALIZED (SELECT a.*, (SELECT min(density) FROM fc b WHERE b.video_id = a.video_id AND b.cell = a.cell AND b.t > a.t - {_T.hold} AND b.t <= a.t) AS run, big FROM fc a JOIN bg USING (video_id, t)),
    grid AS (SELECT video_id, cell, quantile_cont(density, {_T.base_pct}) AS base, CASE WHEN count(*) > 1 THEN sum(moving) / (count(*) - 1) ELSE 0 END <= {_T.max_motion} AS calm FROM cells GROUP BY ALL),
    kept AS MATERIALIZED (SELECT c.video_id, c.t, c.cell, c.occ, c.big, CASE WHEN calm THEN greatest(run - base, 0) ELSE 0 END AS gain FROM cells c JOIN grid USING (video_id, cell)),
    seen AS MATERIALIZED (SELECT *, CASE WHEN gain > {_T.cell_gain} THEN 1 - least(1, greatest(0, occ * 3)) ELSE 0 END AS seen FROM kept),
    tl AS MATERIALIZED (SELECT video_id, t, any_value(big) AS big, avg(gain) AS content, avg(gain * seen) AS visible FROM seen GROUP BY ALL),
    er AS (SELECT n.video_id, n.t, sum(o.gain) AS total, sum(greatest(o.gain - n.gain, 0)) AS lost FROM kept n JOIN kept o ON o.video_id = n.video_id AND o.cell = n.cell AND o.t = n.t - {_T.erase_lag} GROUP BY ALL),
    fl AS MATERIALIZED (SELECT tl.video_id, tl.t FROM tl LEFT JOIN er USING (video_id, t) WHERE big > {_T.cut_frac} OR coalesce(total > 0 AND lost / total > {_T.erase_frac}, FALSE)),
    ac AS (SELECT video_id, min(t) AS t FROM fl GROUP BY 1
           UNION ALL SELECT ac.video_id, (SELECT min(t) FROM fl WHERE fl.video_id = ac.video_id AND fl.t > ac.t + {_T.erase_lag}) AS t FROM ac WHERE ac.t IS NOT NULL),
    cu AS MATERIALIZED (SELECT video_id, t FROM ac WHERE t IS NOT NULL),
    sg AS MATERIALIZED (SELECT tl.*, CASE WHEN EXISTS (SELECT 1 FROM cu WHERE cu.video_id = tl.video_id AND cu.t = tl.t) THEN 1 ELSE 0 END AS cut,
                  (SELECT count(*) FROM cu WHERE cu.video_id = tl.video_id AND cu.t <= tl.t AND cu.t > 0) AS seg FROM tl)"""


def _by_cell(df, *arrays):
    """One row per second and cell."""
    zipped = F.posexplode(F.arrays_zip(*arrays)).alias("cell", "z")
    return df.select("*", zipped).select("video_id", "t", "cell", *[(F.col(f"z.{a}") if a == "moving" else F.round(f"z.{a}", 9)).alias(a) for a in arrays], "big")


@REG.query("frame_cells", _TIMELINE + " SELECT video_id, t, cell, density, run, occ, moving, big FROM cells")
def _(t):
    return _by_cell(_cells(t), "density", "run", "occ", "moving")


@REG.query("frame_cells_binary", _TIMELINE + " SELECT video_id, t, cell, density, run, occ, moving, big FROM cells")
def _(t):
    return _by_cell(op.frame_cells(_binary(t), SMALL), "density", "run", "occ", "moving")


@REG.query("persistent_content", _TIMELINE + " SELECT video_id, t, cell, round(gain, 9) AS gain, occ, big FROM kept")
def _(t):
    return _by_cell(op.persistent_content(_cells(t), SMALL), "gain", "occ")


@REG.query("content_timeline", _TIMELINE + " SELECT video_id, t, round(content, 9) AS content, round(visible, 9) AS visible, big FROM tl")
def _(t):
    return _timeline(t).select("video_id", "t", F.round("content", 9).alias("content"), F.round("visible", 9).alias("visible"), "big")


@REG.query("segment_timeline", _TIMELINE + " SELECT video_id, t, cut, seg FROM sg")
def _(t):
    return op.segment_timeline(_timeline(t), SMALL).select("video_id", "t", "cut", F.col("seg").cast("bigint").alias("seg"))


@REG.query("frame_candidates", _TIMELINE + f""",
    shots AS (SELECT video_id * 1000 + t AS shot_id, video_id, CAST(t AS DOUBLE) AS ra, CAST(t + 5 AS DOUBLE) AS rb FROM frames WHERE t % 10 = 4),
    us AS (SELECT *, count(*) OVER (PARTITION BY video_id) AS segs FROM (SELECT video_id, seg, min(t) AS s0, max(t) AS s1 FROM sg GROUP BY ALL)),
    wi AS (SELECT shot_id, ra, rb, s0, s1, sg.* FROM shots JOIN sg ON sg.video_id = shots.video_id AND sg.t >= ra - {_T.pre} AND sg.t <= rb + {_T.post}
           JOIN us ON us.video_id = sg.video_id AND us.seg = sg.seg WHERE s1 - s0 >= {_T.min_seg} OR segs = 1),
    rf AS (SELECT *, min(t) OVER (PARTITION BY shot_id, seg) AS ref FROM wi),
    fr AS (SELECT rf.shot_id, rf.t, avg(greatest(n.gain - o.gain, 0) * n.seen) AS fresh FROM rf JOIN seen n ON n.video_id = rf.video_id AND n.t = rf.t
           JOIN seen o ON o.video_id = rf.video_id AND o.t = rf.ref AND o.cell = n.cell GROUP BY ALL),
    sc AS (SELECT rf.*, fresh + {_T.total_w} * visible + 1e-7 * rf.t AS score, rf.t <= rb AS during FROM rf JOIN fr ON fr.shot_id = rf.shot_id AND fr.t = rf.t),
    be AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY shot_id, seg, during ORDER BY score DESC, t) = 1),
    ov AS (SELECT *, round(greatest(0, least(s1, rb) - greatest(s0, ra)) / greatest(1, rb - ra), 3) AS ov FROM be WHERE content >= {_T.min_content}),
    nu AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY ov DESC, score DESC) AS no FROM ov)
    SELECT shot_id, video_id, CAST(no AS INT) AS no, t, CAST(ov AS DOUBLE) AS ov, round(score, 9) AS score, s0 AS seg_from, s1 AS seg_to FROM nu WHERE no <= {_T.max_cands}""")
def _(t):
    shots = gray(t).filter("t % 10 = 4").selectExpr("video_id * 1000 + t AS shot_id", "video_id", "CAST(t AS DOUBLE) AS ra", "CAST(t + 5 AS DOUBLE) AS rb")
    return op.frame_candidates(op.segment_timeline(_timeline(t), SMALL), shots, SMALL).withColumn("score", F.round("score", 9))


_OLD = "SELECT l_orderkey AS video_id, l_linenumber AS page, 'p' || CAST(l_partkey AS STRING) || '.png' AS file, 'old' AS src FROM {lineitem} WHERE l_returnflag <> 'N'"
_NEW = "SELECT l_orderkey AS video_id, l_linenumber AS page, 'p' || CAST(l_partkey + l_suppkey % 2 AS STRING) || '.png' AS file, 'new' AS src FROM {lineitem} WHERE l_returnflag <> 'N' AND l_orderkey % 3 = 0"
_TOUCHED = "SELECT DISTINCT l_orderkey AS video_id, l_linenumber AS page FROM {lineitem} WHERE l_orderkey % 3 = 0 AND l_linenumber < 5"
_MF = f"""WITH o AS ({_OLD.replace('{lineitem}', 'lineitem')}), n0 AS ({_NEW.replace('{lineitem}', 'lineitem')}), tc AS ({_TOUCHED.replace('{lineitem}', 'lineitem')}),
    n AS (SELECT n0.* FROM n0 JOIN tc USING (video_id, page)), m AS (SELECT * FROM o WHERE (video_id, page) NOT IN (SELECT (video_id, page) FROM tc) UNION ALL SELECT * FROM n)"""


def _manifest(t):
    old, touched = t.sql(_OLD), t.sql(_TOUCHED)
    new = t.sql(_NEW).join(touched, ["video_id", "page"], "left_semi")
    return old, new, touched, op.merge_frame_manifest(old, new, touched)


@REG.query("merge_frame_manifest", _MF + " SELECT * FROM m")
def _(t):
    return _manifest(t)[3]


@REG.query("orphan_files", _MF + """
    SELECT DISTINCT o.video_id, o.file FROM o JOIN tc USING (video_id, page) WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.video_id = o.video_id AND m.file = o.file)""")
def _(t):
    old, _, touched, merged = _manifest(t)
    return op.orphan_files(old, merged, touched)
