"""DuckDB SQL of greedy choices: block picks and their exchange, k-means rounds, suppression.

A greedy choice is a recursive table with one row per group and step, which carries what is picked so far.
"""

#: CRC-32 of an ASCII text, bit by bit (reflected polynomial 0xEDB88320).
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda ch: unicode(ch)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)), 4294967295::BIGINT)"



def picks(name: str = "", goal: str = "greatest(1, CAST(round_even(sum(n) * 0.2::DOUBLE, 0) AS BIGINT))") -> str:
    """Blocks ``bl`` (g, br, bc, id, n, h) picked greedily up to each g's ``goal``, a fifth of its rows: ``picked`` (g, id), all with ``name`` behind."""
    return f"""tg{name} AS (SELECT g, {goal} AS target FROM bl{name} GROUP BY g),
pk{name}(g, step, total, ids) AS (SELECT g, 0, 0::BIGINT, []::VARCHAR[] FROM tg{name} UNION ALL SELECT g, step + 1, total + n, list_append(ids, id) FROM (
  SELECT pk{name}.g, step, total, ids, n, id, row_number() OVER (PARTITION BY pk{name}.g ORDER BY abs(target - total - n), n DESC, h, br, bc) AS k
  FROM pk{name} JOIN tg{name} ON tg{name}.g = pk{name}.g JOIN bl{name} ON bl{name}.g = pk{name}.g WHERE total < target AND NOT list_contains(ids, id)) WHERE k = 1),
picked{name} AS (SELECT g, unnest(ids) AS id FROM (SELECT g, arg_max(ids, step) AS ids FROM pk{name} GROUP BY g))"""


PICKS = picks()

#: ``test`` (g, id): ``picked`` after the one exchange that brings the share of cdw nearest, if it is off by over 0.2.
EXCHANGE = """cl AS (SELECT bl.g, n, cdw, picked.id IS NOT NULL AS inside, count(*) AS c, arg_min(bl.id, h) AS id FROM bl LEFT JOIN picked ON picked.g = bl.g AND picked.id = bl.id GROUP BY ALL),
sh AS (SELECT g, sum(cdw * c)::DOUBLE / greatest(1, sum(n * c)) AS share, coalesce(sum(n * c) FILTER (inside), 0)::DOUBLE AS size, coalesce(sum(cdw * c) FILTER (inside), 0)::DOUBLE AS hits FROM cl GROUP BY g),
sw AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY off, n1, c1, n2, c2) AS k FROM (SELECT sh.g, a.id AS goes, b.id AS comes, a.n AS n1, a.cdw AS c1, b.n AS n2, b.cdw AS c2, abs(hits / greatest(1.0::DOUBLE, size) - share) AS now,
  abs((hits - a.cdw + b.cdw) / greatest(1.0::DOUBLE, size - a.n + b.n) - share) AS off FROM sh JOIN cl a ON a.g = sh.g AND a.inside JOIN cl b ON b.g = sh.g AND NOT b.inside)),
ch AS (SELECT * FROM sw WHERE k = 1 AND now > 0.2::DOUBLE AND off < now),
test AS (SELECT g, id FROM picked WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.g = picked.g AND ch.goes = picked.id) UNION ALL SELECT g, comes FROM ch)"""

#: Places with their blocks of 2 x 2.
PLACES = "pl AS (SELECT place_key, CAST(grid_x // 2 AS BIGINT) AS br, CAST(grid_y // 2 AS BIGINT) AS bc, count(*) AS rows, count(*) FILTER (label = 'cdw') AS cdw FROM curated GROUP BY place_key, grid_x, grid_y)"


def block_roles(seeds: str) -> str:
    """``ro`` (g, place_key, rows, cdw, role): the block split of all places under each seed of a list."""
    return f"""{PLACES}, bl AS (SELECT g, br, bc, br || '_' || bc AS id, CAST(sum(rows) AS BIGINT) AS n, md5(g || '|' || br || '|' || bc) AS h FROM pl, (SELECT unnest({seeds}) AS g) GROUP BY g, br, bc),
{PICKS}, te AS (SELECT bl.* FROM bl JOIN picked USING (g, id)),
ro AS (SELECT g, place_key, rows, cdw, CASE WHEN EXISTS (SELECT 1 FROM te WHERE te.g = s.g AND te.br = pl.br AND te.bc = pl.bc) THEN 'test'
  WHEN EXISTS (SELECT 1 FROM te WHERE te.g = s.g AND greatest(abs(te.br - pl.br), abs(te.bc - pl.bc)) <= 1) THEN 'buffer' ELSE 'train' END AS role FROM pl, (SELECT unnest({seeds}) AS g) s)"""


def chip_roles(group: str) -> str:
    """``ro``: curated chips with the role of the chip split by ``group``."""
    return f"""c AS (SELECT *, {group} AS g, row_off // 64 AS cr, col_off // 64 AS cc, least(row_off // 128, 2) AS br, least(col_off // 128, 2) AS bc FROM curated),
bl AS (SELECT g, br, bc, br || '_' || bc AS id, count(*) AS n, count(*) FILTER (label = 'cdw') AS cdw, md5('42|' || g || '|' || br || '|' || bc) AS h FROM c GROUP BY g, br, bc),
{PICKS}, {EXCHANGE}, te AS (SELECT DISTINCT c.g, cr, cc FROM c JOIN test ON test.g = c.g AND test.id = c.br || '_' || c.bc),
nr AS (SELECT DISTINCT g, cr + dr AS cr, cc + dc AS cc FROM te, (SELECT unnest([-1, 0, 1]) AS dr), (SELECT unnest([-1, 0, 1]) AS dc)),
ro AS (SELECT c.*, CASE WHEN te.g IS NOT NULL THEN 'test' WHEN nr.g IS NOT NULL THEN 'buffer' ELSE 'train' END AS role FROM c LEFT JOIN te USING (g, cr, cc) LEFT JOIN nr USING (g, cr, cc))"""


#: ``lc`` (i, a1, b1, ..., a3, b3): three integer centroids after each of twenty rounds.
LLOYD = """xy AS (SELECT grid_x AS x, grid_y AS y, count(*) AS w FROM (SELECT DISTINCT place_key, grid_x, grid_y FROM curated) GROUP BY ALL),
st AS (SELECT list({'x': x, 'y': y} ORDER BY md5('42|' || x || '|' || y)) AS s FROM xy),
lc(i, a1, b1, a2, b2, a3, b3) AS (SELECT 0, s[1].x::BIGINT, s[1].y::BIGINT, s[2].x::BIGINT, s[2].y::BIGINT, s[3].x::BIGINT, s[3].y::BIGINT FROM st UNION ALL
  SELECT i + 1, """ + ", ".join(f"coalesce(CAST(round_even(sum(w * {v}) FILTER (c = {k}) / sum(w) FILTER (c = {k}), 0) AS BIGINT), {old}{k})" for k in (1, 2, 3) for v, old in (("x", "a"), ("y", "b"))) + """
  FROM (SELECT *, CASE WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS c FROM (SELECT *, """ + ", ".join(f"(x - a{k}) ** 2 + (y - b{k}) ** 2 AS d{k}" for k in (1, 2, 3)) + """ FROM lc, xy WHERE i < 20)) GROUP BY i, a1, b1, a2, b2, a3, b3),
ce AS (SELECT * FROM lc WHERE i = 20)"""

IOU = "(least(a.maxx, b.maxx) - greatest(a.minx, b.minx))::DOUBLE * (least(a.maxy, b.maxy) - greatest(a.miny, b.miny))"
AREAS = "(a.maxx - a.minx) * (a.maxy - a.miny) + (b.maxx - b.minx) * (b.maxy - b.miny)"
#: Boxes of one raster whose overlap over union exceeds 0.2.
OVERLAP = f"a.raster = b.raster AND a.minx < b.maxx AND b.minx < a.maxx AND a.miny < b.maxy AND b.miny < a.maxy AND {IOU} / ({AREAS} - {IOU}) > 0.2::DOUBLE"
#: ``kept``: boxes ``bo`` (id, raster, confidence, sides) left after each, best first, is dropped if it overlaps a kept one.
SUPPRESS = f"""nb AS (SELECT a.id, list(b.id) AS nb FROM bo a JOIN bo b ON {OVERLAP} AND a.id <> b.id GROUP BY a.id),
rk AS (SELECT bo.id, raster, nb, row_number() OVER (PARTITION BY raster ORDER BY confidence DESC, bo.id) AS k FROM bo LEFT JOIN nb ON nb.id = bo.id),
gr(raster, k, ids) AS (SELECT DISTINCT raster, 0::BIGINT, []::BIGINT[] FROM rk UNION ALL SELECT rk.raster, rk.k, CASE WHEN coalesce(list_has_any(nb, ids), false) THEN ids ELSE list_append(ids, id) END FROM gr JOIN rk ON rk.raster = gr.raster AND rk.k = gr.k + 1),
kept AS (SELECT bo.* FROM bo JOIN (SELECT unnest(ids) AS id FROM (SELECT arg_max(ids, k) AS ids FROM gr GROUP BY raster)) USING (id))"""


def stratified_folds(rows: str, group: str, folds: int, seed: str) -> str:
    """``sf`` (grp, fold): groups of ``rows`` dealt one step at a time, the even part of equal class counts first."""
    every = f"range(1, {folds + 1})"
    return f"""gr AS (SELECT {group} AS grp, count(*) FILTER (label = 'cdw') AS p, count(*) FILTER (label = 'no_cdw') AS q FROM {rows} GROUP BY ALL),
tt AS (SELECT greatest(1, sum(p))::HUGEINT AS a, greatest(1, sum(q))::HUGEINT AS b FROM gr),
st AS (SELECT *, row_number() OVER (ORDER BY 2 * (p * p + q * q) - (p + q) * (p + q) DESC, p DESC, q DESC, j) AS i FROM (SELECT p, q, c, unnest(range(0, c % {folds} + 1)) AS j FROM (SELECT p, q, count(*) AS c FROM gr GROUP BY p, q))),
dl(i, x, y, f) AS (SELECT 0::BIGINT, list_transform({every}, lambda k: 0::BIGINT), list_transform({every}, lambda k: 0::BIGINT), 0::BIGINT UNION ALL
  SELECT i, list_transform({every}, lambda k: x[k] + CASE WHEN j = 0 THEN c // {folds} * p WHEN k = f THEN p ELSE 0 END), list_transform({every}, lambda k: y[k] + CASE WHEN j = 0 THEN c // {folds} * q WHEN k = f THEN q ELSE 0 END), f
  FROM (SELECT st.i, x, y, p, q, c, j, CASE WHEN j = 0 THEN 0 ELSE list_sort(list_transform({every}, lambda k: {{'g': p * x[k] * b * b + q * y[k] * a * a, 'n': x[k] + y[k], 'k': k}}))[1].k END AS f FROM dl JOIN st ON st.i = dl.i + 1, tt)),
tk AS (SELECT p, q, k, max(c) // {folds} + count(*) FILTER (f = k) AS take FROM st JOIN dl USING (i), (SELECT unnest({every}) AS k) GROUP BY p, q, k),
cu AS (SELECT *, sum(take) OVER (PARTITION BY p, q ORDER BY k) AS upto FROM tk),
sf AS (SELECT grp, CAST(k - 1 AS INTEGER) AS fold FROM (SELECT *, row_number() OVER (PARTITION BY p, q ORDER BY md5('{seed}|' || grp), grp) AS rn FROM gr) r JOIN cu ON cu.p = r.p AND cu.q = r.q AND rn > upto - take AND rn <= upto)"""


#: ``ro`` (place_key, region, rows, role): regions by integer k-means, test and val with a buffer each; after ``LLOYD``.
DISTANCE_ROLES = f"""pc AS (SELECT place_key, grid_x AS br, grid_y AS bc, rows, CASE WHEN d1 <= d2 AND d1 <= d3 THEN 0 WHEN d2 <= d3 THEN 1 ELSE 2 END AS g FROM (SELECT *, {", ".join(f"(grid_x - a{k}) ** 2 + (grid_y - b{k}) ** 2 AS d{k}" for k in (1, 2, 3))}
  FROM (SELECT place_key, grid_x, grid_y, count(*) AS rows FROM curated GROUP BY ALL), ce)),
bl AS (SELECT g, br, bc, br || '_' || bc AS id, CAST(sum(rows) AS BIGINT) AS n, md5('42|' || g || '|' || br || '|' || bc) AS h FROM pc GROUP BY g, br, bc),
{picks("", "CAST(round_even(greatest(1, round_even((SELECT sum(rows) FROM pc) * 0.1::DOUBLE, 0)) * sum(n) / (SELECT sum(n) FROM bl), 0) AS BIGINT)")},
te AS (SELECT bl.* FROM bl JOIN picked USING (g, id)), bu AS (SELECT bl.* FROM bl WHERE EXISTS (SELECT 1 FROM te WHERE greatest(abs(te.br - bl.br), abs(te.bc - bl.bc)) <= 1)),
blv AS (SELECT * REPLACE (md5('42v|' || g || '|' || br || '|' || bc) AS h) FROM bl WHERE NOT EXISTS (SELECT 1 FROM bu WHERE bu.br = bl.br AND bu.bc = bl.bc)),
{picks("v", "CAST(round_even(greatest(1, round_even((SELECT sum(rows) FROM pc) * 0.05::DOUBLE, 0)) * sum(n) / (SELECT sum(n) FROM blv), 0) AS BIGINT)")},
tv AS (SELECT blv.* FROM blv JOIN pickedv USING (g, id)),
ro AS (SELECT place_key, g AS region, rows, CASE WHEN EXISTS (SELECT 1 FROM te WHERE te.br = pc.br AND te.bc = pc.bc) THEN 'test' WHEN EXISTS (SELECT 1 FROM bu WHERE bu.br = pc.br AND bu.bc = pc.bc) THEN 'buffer'
  WHEN EXISTS (SELECT 1 FROM tv WHERE tv.br = pc.br AND tv.bc = pc.bc) THEN 'val' WHEN EXISTS (SELECT 1 FROM tv WHERE greatest(abs(tv.br - pc.br), abs(tv.bc - pc.bc)) <= 1) THEN 'buffer' ELSE 'train' END AS role FROM pc)"""

#: ``cs``: curated rows with the role and marks of the cluster split, the best of ten attempts.
CLUSTER_ROLES = f"""pl AS (SELECT place_key, CAST(grid_x AS BIGINT) AS br, CAST(grid_y AS BIGINT) AS bc, count(*) AS rows, count(*) FILTER (label = 'cdw') AS cdw FROM curated GROUP BY place_key, grid_x, grid_y),
bl AS (SELECT g, br, bc, br || '_' || bc AS id, CAST(sum(rows) AS BIGINT) AS n, CAST(sum(cdw) AS BIGINT) AS cdw, md5('2026|' || g || '|' || br || '|' || bc) AS h FROM pl, (SELECT unnest(range(10)) AS g) GROUP BY g, br, bc),
{picks("", "greatest(1, CAST(round_even(sum(n) * 0.1::DOUBLE, 0) AS BIGINT))")}, te AS (SELECT bl.* FROM bl JOIN picked USING (g, id)), rg AS (SELECT bl.* FROM bl WHERE EXISTS (SELECT 1 FROM te WHERE te.g = bl.g AND greatest(abs(te.br - bl.br), abs(te.bc - bl.bc)) <= 1)),
sz AS (SELECT bl.g, sum(bl.n) AS a, (SELECT sum(n) FROM te WHERE te.g = bl.g) AS t FROM bl GROUP BY bl.g),
blv AS (SELECT * REPLACE (md5('2026v|' || g || '|' || br || '|' || bc) AS h) FROM bl WHERE NOT EXISTS (SELECT 1 FROM rg WHERE rg.g = bl.g AND rg.id = bl.id)),
{picks("v", "greatest(1, CAST(round_even(sum(n) * least(0.9::DOUBLE, 0.05::DOUBLE / greatest(1e-9::DOUBLE, 1 - (SELECT t / a FROM sz WHERE sz.g = blv.g))), 0) AS BIGINT))")},
tv AS (SELECT blv.* FROM blv JOIN pickedv USING (g, id)),
zo AS (SELECT bl.*, CASE WHEN te.id IS NOT NULL THEN 'test' WHEN tv.id IS NOT NULL THEN 'val' WHEN EXISTS (SELECT 1 FROM te t WHERE t.g = bl.g AND greatest(abs(t.br - bl.br), abs(t.bc - bl.bc)) <= 1)
  OR EXISTS (SELECT 1 FROM tv v WHERE v.g = bl.g AND greatest(abs(v.br - bl.br), abs(v.bc - bl.bc)) <= 1) THEN 'guard' ELSE 'train' END AS zone FROM bl LEFT JOIN te USING (g, id) LEFT JOIN tv USING (g, id)),
o AS (SELECT g, greatest(coalesce(abs(sum(cdw) FILTER (zone = 'test') / sum(n) FILTER (zone = 'test') - sum(cdw) / sum(n)), 2), coalesce(abs(sum(cdw) FILTER (zone = 'val') / sum(n) FILTER (zone = 'val') - sum(cdw) / sum(n)), 2)) AS off FROM zo GROUP BY g),
w AS (SELECT g FROM o ORDER BY CASE WHEN off <= 0.05::DOUBLE THEN 0 ELSE off END, g LIMIT 1),
cs AS (SELECT c.*, CAST(w.g AS INTEGER) AS attempt, CASE WHEN zone <> 'train' THEN zone WHEN source IN ('manual', 'auto_reviewed') OR model_prob BETWEEN 0.05 AND 0.30 OR model_prob BETWEEN 0.70 AND 0.95 THEN 'train' ELSE 'none' END AS role,
  zone = 'train' AND source IN ('manual', 'auto_reviewed') AS is_manual, source NOT IN ('manual', 'auto_reviewed') AND coalesce(model_prob >= 0.95 OR model_prob <= 0.05, false) AS is_pseudo
  FROM curated c, w JOIN zo ON zo.g = w.g WHERE zo.br = c.grid_x AND zo.bc = c.grid_y)"""
