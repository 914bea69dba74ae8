"""Plan-drawing tables derived from the given Parquet tables; all their numbers are integers.

Each view is a source table and a list of expressions that Spark and DuckDB read alike. ``SHARED`` holds views on views, for
SQL twins only.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, tuple[str, list[str]]] = {
    "layer_config": (
        "supplier",
        ["s_suppkey % 20 as drawing_id", "case s_suppkey % 4 when 0 then 'WALL' when 1 then 'S-WALL' when 2 then 'BEAM' else 'S-GRID-1' end as layer"],
    ),
    "segments": (
        "orders",
        [
            "o_orderkey as seg_id",
            "o_custkey % 20 as drawing_id",
            "(o_orderkey * 7919) % 40000 as x1",
            "(o_orderkey * 104729) % 30000 as y1",
            "(o_orderkey * 7919) % 40000 + case when o_orderkey % 2 = 0 then 200 + o_orderkey % 800 else 0 end as x2",
            "(o_orderkey * 104729) % 30000 + case when o_orderkey % 2 = 1 then 200 + o_orderkey % 800 else 0 end as y2",
            "case o_orderpriority when '1-URGENT' then 'S-FNDN-1' when '2-HIGH' then 'S-BEAM-1' when '3-MEDIUM' then 'A-WALL' when '4-NOT SPECIFIED' then 'A-WALL-2' else 'A-DETL-1' end as layer",
        ],
    ),
    "faces": (
        "part",
        [
            "p_partkey as face_id",
            "p_partkey % 20 as drawing_id",
            "(p_partkey * 7919) % 52000 as x0",
            "(p_partkey * 104729) % 48000 as y0",
            "(p_partkey * 7919) % 52000 + 100 * (1 + cast(p_size as bigint)) as x1",
            "(p_partkey * 104729) % 48000 + 100 * (1 + p_partkey % 40) as y1",
            "p_brand as layer",
        ],
    ),
    "records": (
        "part",
        [
            "p_partkey as face_id",
            "p_partkey % 20 as drawing_id",
            "(p_partkey * 7919) % 52000 as x0",
            "(p_partkey * 104729) % 48000 as y0",
            "(p_partkey * 7919) % 52000 + 100 * (1 + cast(p_size as bigint)) as x1",
            "(p_partkey * 104729) % 48000 + 100 * (1 + p_partkey % 40) as y1",
            "100 * (1 + cast(p_size as bigint)) * (100 * (1 + p_partkey % 40)) as area_native",
            "case when p_partkey % 11 = 0 then 'deleted' when p_partkey % 17 = 3 then null else 'active' end as status",
            "case p_partkey % 5 when 0 then 'seed' when 1 then 'manual' else 'auto' end as source",
            "(p_partkey % 13 = 0) as scope_excluded",
            "case p_partkey % 9 when 0 then 'obstacle' when 1 then null else 'partition' end as geometry_role",
            "case p_partkey % 4 when 0 then ' Approved ' when 1 then 'pending' when 2 then 'Needs-Review' else 'rejected' end as review",
            "concat('INT-', cast(p_partkey % 25 + 1 as varchar(10))) as zone",
        ],
    ),
    "redrawn": (
        "part",
        [
            "p_partkey as face_id",
            "p_partkey % 20 as drawing_id",
            "(p_partkey * 7919) % 52000 + 10 * (p_partkey % 7) as x0",
            "(p_partkey * 104729) % 48000 + 10 * (p_partkey % 3) as y0",
            "(p_partkey * 7919) % 52000 + 100 * (1 + cast(p_size as bigint)) as x1",
            "(p_partkey * 104729) % 48000 + 100 * (1 + p_partkey % 40) as y1",
        ],
    ),
    "polygons": (  # five corners: slanted at the bottom, an upper side bent in or out
        "part",
        [
            "p_partkey as face_id",
            "p_partkey % 20 as drawing_id",
            "(p_partkey * 7919) % 52000 as x0",
            "(p_partkey * 7919) % 52000 + 50 * (1 + cast(p_size as bigint)) as xm",
            "(p_partkey * 7919) % 52000 + 100 * (1 + cast(p_size as bigint)) as x1",
            "(p_partkey * 104729) % 48000 + 1000 as y0",
            "(p_partkey * 104729) % 48000 + 1000 + 100 * (p_partkey % 9 - 4) as y1",
            "(p_partkey * 104729) % 48000 + 1500 + 100 * (p_partkey % 40) as y2",
            "(p_partkey * 104729) % 48000 + 1500 + 50 * (p_partkey % 77) as ym",
            "(p_partkey * 104729) % 48000 + 1500 + 100 * (p_partkey % 31) as y3",
        ],
    ),
    "blocks": (  # kind 0 a closed outline, 1 four lines around it, 2 two lines of a corner, 3 nothing of its own
        "supplier",
        ["s_suppkey as block", "100 * (1 + s_suppkey % 7) as w", "100 * (2 + s_suppkey % 5) as h", "s_suppkey % 4 as kind"],
    ),
    "nested": (  # blocks in blocks, some of which hold themselves
        "supplier",
        [
            "s_suppkey as block",
            "case when s_suppkey % 10 = 9 then s_suppkey when s_suppkey % 4 = 3 then s_suppkey - 1 when s_suppkey % 4 = 0 then cast(floor(s_suppkey / 2) as bigint) end as child",
            "3000 + 7 * s_suppkey as x",
            "2000 + 1000 * (s_suppkey % 5) as y",
            "90 * (s_suppkey % 4) as angle",
        ],
    ),
    "placed": (  # inserts of the column layer; block 0 is not defined
        "lineitem",
        [
            "(l_orderkey % 20 * 10000000 + l_partkey * 10) * 10000000 + l_suppkey * 100 as insert_id",
            "(l_partkey + l_suppkey) % 11 as block",
            "l_partkey * 10 as x",
            "l_suppkey * 100 as y",
            "1 + l_partkey % 2 as scale",
            "90 * (l_suppkey % 4) as angle",
            "l_returnflag = 'N' and l_suppkey % 10 = 9 as is_column",
        ],
    ),
    "bays": (
        "nation",
        [
            "cast(n_nationkey as bigint) + 1 as bay_id",
            "cast((n_nationkey - n_nationkey % 5) / 5 as bigint) as row_no",
            "cast(n_nationkey % 5 as bigint) as col_no",
            "cast(n_nationkey % 5 as bigint) * 10000 as x0",
            "cast((n_nationkey - n_nationkey % 5) / 5 as bigint) * 10000 as y0",
            "cast(n_nationkey % 5 as bigint) * 10000 + 10000 as x1",
            "cast((n_nationkey - n_nationkey % 5) / 5 as bigint) * 10000 + 10000 as y1",
        ],
    ),
    "seeds": ("customer", ["c_custkey as seed_id", "c_custkey % 20 as drawing_id", "(c_custkey * 6151) % 50000 as x", "(c_custkey * 12289) % 50000 as y"]),
    "grid_lines": (
        "supplier",
        ["s_suppkey as line_id", "s_suppkey % 5 as drawing_id", "case when s_suppkey % 2 = 0 then 0 else 90 end as angle_deg", "(s_suppkey * 193) % 20000 as position_mm", "500 + (s_suppkey * 97) % 9000 as length_mm"],
    ),
    "review_events": (
        "events",
        [
            "event_id",
            "user_id as session_id",
            "ts",
            "value",
            "case event_type when 'click' then 'select' when 'view' then 'open_gap' when 'signup' then 'recover' when 'purchase' then 'approve' else 'delete' end as action",
            "event_id % 500 as face_id",
        ],
    ),
    "entities": (
        "lineitem",
        [
            "l_orderkey % 20 as drawing_id",
            "case l_returnflag when 'A' then 'LINE' when 'R' then 'LWPOLYLINE' else 'INSERT' end as entity_type",
            "case when l_suppkey % 10 < 4 then 'WALL' when l_suppkey % 10 < 7 then 'S-FNDN-1' when l_suppkey % 10 = 7 then 'S-GRID-1' when l_suppkey % 10 = 8 then 'TEXT-NOTES' else 'S-COLS' end as layer",
            "l_partkey * 10 as x",
            "l_suppkey * 100 as y",
        ],
    ),
    "manifest_zones": (
        "nation",
        ["concat('INT-', cast(n_nationkey + 3 as varchar(10))) as label", "case when n_nationkey % 7 = 0 then null else 300000000 + 1000000 * cast(n_nationkey as bigint) end as area_native"],
    ),
    "pilot_sessions": (
        "orders",
        [
            "case when o_orderkey % 23 = 0 then null else concat('s', cast(o_orderkey as varchar(20))) end as session_id",
            "concat('e', cast(o_custkey % 7 as varchar(5))) as engineer",
            "case o_orderkey % 6 when 0 then ' n' when 1 then 'N' when 2 then null else 'y ' end as saved_ok",
            "case when o_orderkey % 9 = 0 then 'N' else 'Y' end as export_ok",
            "case when o_orderkey % 3 = 0 then 'Y' else 'N' end as useful",
            "o_orderkey % 90 as minutes",
        ],
    ),
}

#: Pairs of free ends, the nearest of all first: rounds in which pairs that are nearest for both of their ends are taken. Each
#: round takes most ends, so the number of rounds is far above what any of the tables needs.
ROUNDS = 24


def _pairing() -> dict[str, str]:
    d2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"
    out = {
        "gap_pairs0": f"select a.drawing_id, a.x as ax, a.y as ay, b.x as bx, b.y as by_, {d2} as d2, a.layer as al, b.layer as bl, least(abs(a.bearing - b.bearing), 360 - abs(a.bearing - b.bearing)) as delta "
        f"from free_ends a join free_ends b on a.drawing_id = b.drawing_id and (a.x < b.x or (a.x = b.x and a.y < b.y)) and a.seg_id <> b.seg_id where {d2} <= 100000000"
    }
    for k in range(ROUNDS):
        p = f"gap_pairs{k}"
        each = f"select drawing_id, ax as x, ay as y, d2, ax, ay, bx, by_ from {p} union all select drawing_id, bx, by_, d2, ax, ay, bx, by_ from {p}"
        best = f"select drawing_id, x, y, min({{'d': d2, 'ax': ax, 'ay': ay, 'bx': bx, 'by': by_}}) as m from ({each}) e group by 1, 2, 3"
        out[f"gap_taken{k}"] = f"select p.* from {p} p join (select drawing_id, m from ({best}) n group by 1, 2 having count(*) = 2) t on t.drawing_id = p.drawing_id and t.m.ax = p.ax and t.m.ay = p.ay and t.m.bx = p.bx and t.m.by = p.by_"
        used = f"select drawing_id, ax as x, ay as y from gap_taken{k} union all select drawing_id, bx, by_ from gap_taken{k}"
        out[f"gap_pairs{k + 1}"] = f"select p.* from {p} p anti join ({used}) u on u.drawing_id = p.drawing_id and u.x = p.ax and u.y = p.ay anti join ({used}) v on v.drawing_id = p.drawing_id and v.x = p.bx and v.y = p.by_"
    taken = " union all ".join(f"select * from gap_taken{k}" for k in range(ROUNDS))
    out["gap_taken"] = taken
    out["gaps"] = (
        "select drawing_id, ax, ay, bx, by_, d2, sqrt(d2) as distance, al, bl, delta, case when d2 <= 250000 then 'within_threshold_unclosed' when d2 <= 1000000 then 'above_threshold_close' else 'large_gap_manual_review' end as status from gap_taken "
        "union all select f.drawing_id, f.x, f.y, null, null, null, null, f.layer, '', null, 'orphan_endpoint' from free_ends f anti join (select drawing_id, ax as x, ay as y from gap_taken union all select drawing_id, bx, by_ from gap_taken) u on u.drawing_id = f.drawing_id and u.x = f.x and u.y = f.y"
    )
    out["gap_failed"] = "select *, case when delta > 75 then 'bearing_mismatch_suspected' else 'greedy_pairing_conflict' end as reason from gaps where status = 'within_threshold_unclosed'"
    return out


FREE = "select drawing_id, x, y, min(layer) as layer, min(seg_id) as seg_id from (select drawing_id, seg_id, x1 as x, y1 as y, layer from segments union all select drawing_id, seg_id, x2, y2, layer from segments) e group by drawing_id, x, y having count(*) = 1"
def _unique(view: str) -> str:
    """Pairs whose ends are in no other pair."""
    ends = f"select drawing_id, x, y from (select drawing_id, ax as x, ay as y from {view} union all select drawing_id, bx, by_ from {view}) e group by 1, 2, 3 having count(*) = 1"
    return f"select c.* from {view} c join ({ends}) a on a.drawing_id = c.drawing_id and a.x = c.ax and a.y = c.ay join ({ends}) b on b.drawing_id = c.drawing_id and b.x = c.bx and b.y = c.by_"


def union_sql(view: str, keys: str) -> str:
    """Area of the union of each key's boxes."""
    k = [x.strip() for x in keys.split(",")]
    on = " and ".join(f"v.{x} = s.{x}" for x in k)
    own = ", ".join(f"v.{x}" for x in k)
    edges = f"select {keys}, x as xa, lead(x) over (partition by {keys} order by x) as xb from (select distinct {keys}, x0 as x from {view} union select distinct {keys}, x1 from {view}) e"
    strips = f"select {own}, s.xa, s.xb, v.y0, v.y1, max(v.y1) over (partition by {own}, s.xa order by v.y0, v.y1 rows between unbounded preceding and 1 preceding) as reach from {view} v join ({edges}) s on {on} and v.x0 <= s.xa and v.x1 >= s.xb"
    return f"select {keys}, cast(sum((xb - xa) * greatest(0, y1 - greatest(y0, coalesce(reach, y0)))) as bigint) as area from ({strips}) t group by {keys}"


_LINES = {"low": ("x0", "y0", "x1", "y1"), "left": ("x0", "y3", "xm", "ym"), "right": ("xm", "ym", "x1", "y2")}


def _at(p: str, line: str, x: str) -> str:
    a, b, c, d = (f"{p}.{n}" for n in _LINES[line])
    return f"({b} + ({x} - {a}) * cast({d} - {b} as double) / ({c} - {a}))"


def _pentagons() -> dict[str, str]:
    """Shared areas of ``polygons``: at every x each is one stretch, so the common length is integrated between the corners and all crossings."""
    cross = []
    for one in _LINES:
        for other in _LINES:
            (a, b, c, d), (e, f, g, h) = ([f"{p}.{n}" for n in _LINES[k]] for p, k in (("a", one), ("b", other)))
            slope = f"(cast({d} - {b} as double) / ({c} - {a}) - cast({h} - {f} as double) / ({g} - {e}))"
            cross.append(f"({f} - {b} + {a} * cast({d} - {b} as double) / ({c} - {a}) - {e} * cast({h} - {f} as double) / ({g} - {e})) / nullif({slope}, 0)")
    xs = ", ".join(["cast(a.x0 as double)", "a.xm", "a.x1", "b.x0", "b.xm", "b.x1", *cross])
    top = lambda p, x: f"case when {x} <= {p}.xm then {_at(p, 'left', x)} else {_at(p, 'right', x)} end"
    length = lambda x: f"greatest(0, least({top('a', x)}, {top('b', x)}) - greatest({_at('a', 'low', x)}, {_at('b', 'low', x)}))"
    return {
        "pentagon_area": "select face_id, ((ym + y3) * (xm - x0) + (y2 + ym) * (x1 - xm) - (y0 + y1) * (x1 - x0)) / 2.0 as area from polygons",
        "pentagon_marks": f"select distinct a.face_id as a, b.face_id as b, unnest([{xs}]) as x from polygons a join polygons b on a.drawing_id = b.drawing_id and a.face_id < b.face_id and a.x0 < b.x1 and b.x0 < a.x1 and least(a.y0, a.y1) < greatest(b.y2, b.ym, b.y3) and least(b.y0, b.y1) < greatest(a.y2, a.ym, a.y3)",
        "pentagon_steps": "select m.a, m.b, x as l, lead(x) over (partition by m.a, m.b order by x) as r from pentagon_marks m join polygons a on a.face_id = m.a join polygons b on b.face_id = m.b where x between greatest(a.x0, b.x0) and least(a.x1, b.x1)",
        "pentagon_shared": f"select s.a, s.b, sum((s.r - s.l) * ({length('s.l')} + {length('s.r')}) / 2) as shared from pentagon_steps s join polygons a on a.face_id = s.a join polygons b on b.face_id = s.b where s.r is not null group by 1, 2",
    }


SHARED = {
    **_pentagons(),
    "snap_points": "select drawing_id, x, y, count(*) as n from (select drawing_id, x1 as x, y1 as y from segments union all select drawing_id, x2, y2 from segments) e group by 1, 2, 3",
    "snap_links": "select a.drawing_id, a.x, a.y, b.x as bx, b.y as by_ from snap_points a join snap_points b on a.drawing_id = b.drawing_id and b.x between a.x - 40 and a.x + 40 and b.y between a.y - 40 and a.y + 40 and (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 1600",
    "snap_reach": "select drawing_id, x, y, bx as rx, by_ as ry from snap_links union select r.drawing_id, r.x, r.y, l.bx, l.by_ from snap_reach r join snap_links l on l.drawing_id = r.drawing_id and l.x = r.rx and l.y = r.ry",
    "snap_label": "select drawing_id, x, y, min({'x': rx, 'y': ry}) as l from snap_reach group by 1, 2, 3",
    "snap_to": "select s.drawing_id, s.l, sum(s.x * p.n) / cast(sum(p.n) as double) as nx, sum(s.y * p.n) / cast(sum(p.n) as double) as ny from snap_label s join snap_points p on p.drawing_id = s.drawing_id and p.x = s.x and p.y = s.y group by 1, 2",
    "snapped": "select s.drawing_id, s.x, s.y, t.nx, t.ny from snap_label s join snap_to t on t.drawing_id = s.drawing_id and t.l = s.l",
    "block_ways": (  # placements by exact turns: (a, b; c, d) and a shift
        "select insert_id, block, 0 as depth, scale * ca as a, -scale * sa as b, scale * sa as c, scale * ca as d, x as tx, y as ty, [block] as way from (select distinct insert_id, block, x, y, scale, case angle when 0 then 1 when 180 then -1 else 0 end as ca, case angle when 90 then 1 when 270 then -1 else 0 end as sa from placed where is_column) p "
        "union all select w.insert_id, n.child, w.depth + 1, w.a * n.ca + w.b * n.sa, -w.a * n.sa + w.b * n.ca, w.c * n.ca + w.d * n.sa, -w.c * n.sa + w.d * n.ca, w.a * n.x + w.b * n.y + w.tx, w.c * n.x + w.d * n.y + w.ty, list_append(w.way, n.child) "
        "from block_ways w join (select *, case angle when 0 then 1 when 180 then -1 else 0 end as ca, case angle when 90 then 1 when 270 then -1 else 0 end as sa from nested where child is not null) n on n.block = w.block where not list_contains(w.way, n.child)"
    ),
    "zone_boxes": "select f.drawing_id, a.bay_id, f.face_id, f.x0, f.y0, f.x1, f.y1 from faces f join assigned a on a.face_id = f.face_id where (f.x1 - f.x0) * (f.y1 - f.y0) >= 1000000",
    "zone_touch": "select a.face_id as a, b.face_id as b from zone_boxes a join zone_boxes b on a.drawing_id = b.drawing_id and a.bay_id = b.bay_id and a.face_id <> b.face_id and ((a.x0 < b.x1 and b.x0 < a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1) or (a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 < b.y1 and b.y0 < a.y1))",
    "zone_reach": "select face_id, face_id as root from zone_boxes union select t.b, r.root from zone_reach r join zone_touch t on t.a = r.face_id",
    "zone_parts": "select z.*, p.part from zone_boxes z join (select face_id, min(root) as part from zone_reach group by 1) p on p.face_id = z.face_id",
    "zone_areas": union_sql("zone_parts", "drawing_id, bay_id, part"),
    "zone_best": "select drawing_id, bay_id, area, part from (select *, row_number() over (partition by drawing_id, bay_id order by area desc, part) as r from zone_areas) b where r = 1",
    "zones": "select z.drawing_id, z.bay_id, string_agg(cast(z.face_id as varchar), ',' order by z.face_id) as face_ids, cast(count(*) as bigint) as faces, cast(sum((z.x1 - z.x0) * (z.y1 - z.y0)) as bigint) as face_sum, max(b.area) as area from zone_boxes z join zone_best b on b.drawing_id = z.drawing_id and b.bay_id = z.bay_id group by 1, 2",
    "zone_largest": "select p.drawing_id, p.bay_id, p.x0, p.y0, p.x1, p.y1 from zone_parts p join zone_best b on b.drawing_id = p.drawing_id and b.bay_id = p.bay_id and b.part = p.part",
    "zone_meet": "select distinct a.drawing_id, a.bay_id as za, b.bay_id as zb from zone_largest a join zone_largest b on a.drawing_id = b.drawing_id and a.bay_id < b.bay_id and a.x0 < b.x1 and b.x0 < a.x1 and a.y0 < b.y1 and b.y0 < a.y1",
    "zone_both": "select m.drawing_id, m.za, m.zb, z.x0, z.y0, z.x1, z.y1 from zone_meet m join zone_largest z on z.drawing_id = m.drawing_id and (z.bay_id = m.za or z.bay_id = m.zb)",
    "zone_united": union_sql("zone_both", "drawing_id, za, zb"),
    "zone_all": "select d.drawing_id, b.bay_id, 'INT-' || b.bay_id as label, coalesce(z.faces, 0) as faces, coalesce(z.face_sum, 0) as face_sum, coalesce(z.area, 0) as area, (b.x1 - b.x0) * (b.y1 - b.y0) as bay_area from (select distinct drawing_id from faces) d cross join bays b left join zones z on z.drawing_id = d.drawing_id and z.bay_id = b.bay_id",
    "zone_flags": (
        "select drawing_id, 'zone_face_coverage' as gate, label, bay_id, 8 as named from zone_all where faces = 0 "
        "union all select drawing_id, 'union_vs_clipped_bay', label, bay_id, 6 from zone_all where bay_area > 0 and area * 20 < bay_area "
        "union all select drawing_id, 'face_sum_vs_union', label, bay_id, 6 from zone_all where area > 0 and abs(face_sum - area) * 50 > area"
    ),
    "zone_named": "select drawing_id, gate, count(*) as n, array_to_string(list(label order by bay_id)[1:max(named)], ', ') as labels from zone_flags group by 1, 2",
    "zone_orphans": "select f.drawing_id, cast(count(*) filter (where a.face_id is null and (f.x1 - f.x0) * (f.y1 - f.y0) >= 1000000) as bigint) as orphans from faces f left join assigned a on a.face_id = f.face_id group by 1",
    "zone_manifest": "select z.drawing_id, z.label, z.faces, m.area_native, (m.area_native > 0) as has_area, (m.area_native > 0 and abs(z.area - m.area_native) * 2000 <= m.area_native) as within from zone_all z join manifest_zones m on m.label = z.label",
    "zone_reconciled": (
        "select l.drawing_id, l.label, z.label is not null as built, m.label is not null as listed, m.area_native as expected, coalesce(z.area, 0) as found, coalesce(z.faces, 0) as faces, coalesce(m.area_native > 0, false) as has_area, "
        "coalesce(m.area_native > 0 and abs(coalesce(z.area, 0) - m.area_native) * 2000 <= m.area_native, false) as within "
        "from (select drawing_id, label from (select distinct drawing_id from faces) d cross join (select 'INT-' || bay_id as label from bays union select label from manifest_zones) n) l left join zone_all z on z.drawing_id = l.drawing_id and z.label = l.label left join manifest_zones m on m.label = l.label"
    ),
    "zone_gates": (
        "select d.drawing_id, 'zone_count' as gate, 1 as place, case when z.n = e.n then 'PASS' else 'REVIEW' end as status, z.n || ' zones vs expected ' || e.n as detail from (select distinct drawing_id from faces) d, (select count(*) as n from bays) z, (select count(*) as n from manifest_zones) e "
        "union all select drawing_id, 'orphan_faces', 2, case when orphans = 0 then 'PASS' else 'FAIL' end, orphans || ' orphan(s) (max allowed 0)' from zone_orphans "
        "union all select d.drawing_id, 'zone_face_coverage', 3, case when n.n is null then 'PASS' else 'REVIEW' end, coalesce('Empty zones: ' || n.labels || case when n.n > 8 then ' (+' || (n.n - 8) || ' more)' else '' end, 'All zones have faces') from (select distinct drawing_id from faces) d left join zone_named n on n.drawing_id = d.drawing_id and n.gate = 'zone_face_coverage' "
        "union all select d.drawing_id, 'union_vs_clipped_bay', 4, case when n.n is null then 'PASS' else 'REVIEW' end, coalesce('Low union/bay coverage: ' || n.labels, 'Union area tracks clipped bays') from (select distinct drawing_id from faces) d left join zone_named n on n.drawing_id = d.drawing_id and n.gate = 'union_vs_clipped_bay' "
        "union all select d.drawing_id, 'face_sum_vs_union', 5, case when n.n is null then 'PASS' else 'REVIEW' end, coalesce('Sum != union (>2%): ' || n.labels, 'Face areas consistent with union') from (select distinct drawing_id from faces) d left join zone_named n on n.drawing_id = d.drawing_id and n.gate = 'face_sum_vs_union' "
        "union all select drawing_id, 'manifest_area', 6, case when count(*) filter (where has_area) = 0 then 'SKIP' when count(*) filter (where within) = count(*) filter (where has_area) then 'PASS' else 'FAIL' end, case when count(*) filter (where has_area) = 0 then 'No manifest area_sqm values filled' else count(*) filter (where within) || '/' || count(*) filter (where has_area) || ' within 0.05% tolerance' end from zone_manifest group by 1"
    ),
    **_pairing(),
    "ends": "select drawing_id, seg_id, x1 as x, y1 as y, layer, case when y1 = y2 then 180 else 270 end as bearing from segments union all select drawing_id, seg_id, x2, y2, layer, case when y1 = y2 then 0 else 90 end from segments",
    "points": "select drawing_id, x, y, cast(count(*) as bigint) as degree, min(layer) as layer, min(seg_id) as seg_id, min(bearing) as bearing from ends group by drawing_id, x, y",
    "free_ends": "select drawing_id, x, y, layer, seg_id, bearing from points where degree = 1",
    "candidate_pairs": (
        "select a.drawing_id, a.x as ax, a.y as ay, b.x as bx, b.y as by_, a.layer as al, b.layer as bl, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as d2, least(abs(a.bearing - b.bearing), 360 - abs(a.bearing - b.bearing)) as delta "
        "from free_ends a join free_ends b on a.drawing_id = b.drawing_id and (a.x < b.x or (a.x = b.x and a.y < b.y)) and a.seg_id <> b.seg_id "
        "where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 250000"
    ),
    "profile_pairs": "select * from candidate_pairs where (sqrt(d2) between 145 and 155 or sqrt(d2) between 175 and 185) and delta >= 135",
    "profile_unique": _unique("profile_pairs"),
    "micro_pairs": "select c.* from candidate_pairs c where d2 <= 225 and (delta <= 35 or delta between 85 and 95 or delta >= 175) and not exists (select 1 from profile_unique u where u.drawing_id = c.drawing_id and ((u.ax = c.ax and u.ay = c.ay) or (u.bx = c.ax and u.by_ = c.ay) or (u.ax = c.bx and u.ay = c.by_) or (u.bx = c.bx and u.by_ = c.by_)))",
    "micro_unique": _unique("micro_pairs"),
    "face_bays": (
        "select f.drawing_id, f.face_id, b.bay_id, (least(f.x1, b.x1) - greatest(f.x0, b.x0)) * (least(f.y1, b.y1) - greatest(f.y0, b.y0)) as area "
        "from faces f join bays b on f.x0 < b.x1 and b.x0 < f.x1 and f.y0 < b.y1 and b.y0 < f.y1"
    ),
    "assigned": "select drawing_id, face_id, bay_id, area from (select *, row_number() over (partition by face_id order by area desc, bay_id) as r from face_bays) o where r = 1",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = VIEWS[name]
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*columns)


def twin(body: str) -> str:
    """The SQL with the views that it names, and those that these name, put in front."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in [*VIEWS, *SHARED]:
            if re.search(rf"(\b(from|join)|,)\s+{name}\b", text) and name not in order:
                if name in SHARED:
                    need(SHARED[name].replace(f"from {name} ", ""))  # a recursive view names itself
                order.append(name)

    need(body)
    texts = {n: f"select {', '.join(VIEWS[n][1])} from {VIEWS[n][0]}" if n in VIEWS else SHARED[n] for n in order}
    body = body.strip()
    if not order:
        return body
    often = lambda n: "materialized " if n.startswith(("gap_", "gaps", "free_ends", "zone")) and n not in ("zone_reach", "block_ways", "snap_reach") else ""
    views = ", ".join(f"{n} as {often(n)}({t})" for n, t in texts.items())
    return f"with recursive {views}, {body[5:]}" if body.lower().startswith("with ") else f"with recursive {views} {body}"
