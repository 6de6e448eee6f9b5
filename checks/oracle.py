"""The results of ``checks.queries`` as SQL for DuckDB, written independently.

Every statement is a chain of common table expressions, of which DuckDB evaluates
the ones a statement uses, and a final SELECT.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from checks.queries import N_DRAWS, N_FOLDS, NODES, SEED

RAW = """
site_src AS (
  SELECT n_nationkey AS k, n_name AS name, r_name AS region
  FROM nation LEFT JOIN region ON n_regionkey = r_regionkey),
raw_sites AS (
  SELECT name AS "Lake", (10 + 5 * (k % 4))::DOUBLE AS "SA", (k // 13)::INTEGER AS "Access",
         ((k * 37) % 100)::DOUBLE AS "DistKam", ((k * 53) % 100)::DOUBLE AS "DistVan",
         (3 + k % 7) / 10.0::DOUBLE AS "Pseen", (k % 2)::INTEGER AS "Launch",
         (k % 3)::INTEGER AS "Camp", (k % 5)::INTEGER AS "Resort", k::VARCHAR AS "WBID",
         region AS "Region", (k * 100)::DOUBLE AS "Elevation", (k * 2)::DOUBLE AS "Perim",
         (k * 3)::DOUBLE AS "Mdepth", (k * 1.5)::DOUBLE AS "MuDepth", k::DOUBLE AS "Distgravel"
  FROM site_src),
ev AS (
  SELECT e.*, s.k, s.name, s.region, (2008 + event_id % 3)::INTEGER AS yr,
         (dayofyear(ts) + 120)::INTEGER AS d, (8 + 4 * (hour(ts) // 8))::INTEGER AS h
  FROM events e JOIN site_src s ON s.k = e.user_id % 25),
raw_obs AS (
  SELECT event_id AS obs_seq, yr AS "Year", name AS "Name", region AS "Region",
         CASE WHEN event_type IN ('click', 'error') OR (k = 11 AND d > 128)
                OR (k % 2 = 0 AND (d + 3 * k) % 6 = 0)
                OR (k % 3 = 1 AND d BETWEEN 140 AND 144) THEN 'GR' ELSE 'CAM' END AS "Method",
         h AS "Hour", floor(value / 25)::INTEGER AS "TotalAnglerCount", d AS "DoY",
         CASE WHEN h >= 12 THEN 2 ELSE 1 END AS "ToD",
         ((yr - 2000) * 366 + d)::DOUBLE + h / 24.0::DOUBLE AS "datetime",
         (1 + event_id % 2)::INTEGER AS "location",
         CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS "weekend",
         strftime(ts, '%Y-%m-%d') AS "Date", day(ts)::INTEGER AS "Day",
         month(ts)::INTEGER AS "Month", k::VARCHAR AS "WBID", h || ':00' AS "Time",
         1 AS "Include", (isodow(ts) - 1)::VARCHAR AS "DoW"
  FROM ev),
dedup AS (
  SELECT min(obs_seq) AS obs_seq, * EXCLUDE (obs_seq)
  FROM raw_obs
  GROUP BY ALL),
norm AS (
  SELECT obs_seq, "Year" AS "year", "Name" AS "name", "Region" AS "region",
         "Method" AS "method", "Hour" AS "hour", "TotalAnglerCount" AS "angler_count",
         "DoY" AS "julian_day", "ToD" AS "time_of_day", "datetime", "location", "weekend"
  FROM dedup),
site_norm AS (
  SELECT "Lake" AS "name", "SA" AS "area", "Access" AS "access", "DistKam" AS "dist_kam",
         "DistVan" AS "dist_van", "Pseen" AS "p_seen", "Launch" AS "launch", "Camp" AS "camp",
         "Resort" AS "resort"
  FROM raw_sites),
site_ids AS (
  SELECT name, row_number() OVER (ORDER BY name)::BIGINT AS site_id
  FROM (SELECT DISTINCT "Name" AS name FROM raw_obs)),
joined AS (
  SELECT n.*, i.site_id, s.area, s.access, s.dist_kam, s.dist_van, s.p_seen, s.launch,
         s.camp, s.resort
  FROM norm n JOIN site_ids i ON i.name = n.name LEFT JOIN site_norm s ON s.name = n.name),
eff AS (
  SELECT * EXCLUDE (name, datetime), round(datetime * 100)::BIGINT AS slot,
         100 * "year" + site_id AS season_code,
         round(datetime * 100)::BIGINT * 1000 + site_id AS slot_code
  FROM joined WHERE name NOT IN ('NATION_7', 'NATION_9')),
gr AS (
  SELECT * EXCLUDE (method, angler_count), angler_count AS ground_count
  FROM eff WHERE method = 'GR'),
cam AS (
  SELECT * EXCLUDE (method, angler_count), angler_count AS cam_count,
         10 * site_id + location AS sensor_code
  FROM eff WHERE method = 'CAM'),
firsts AS (
  SELECT site_id, slot, location AS cam_location, cam_count, sensor_code,
         row_number() OVER (PARTITION BY site_id, slot, location ORDER BY obs_seq) AS rn
  FROM cam),
paired AS (
  SELECT g.*, l.cam_location, f.cam_count, f.sensor_code
  FROM gr g
  CROSS JOIN (SELECT DISTINCT location AS cam_location FROM eff) l
  LEFT JOIN (SELECT * FROM firsts WHERE rn = 1) f
    ON f.site_id = g.site_id AND f.slot = g.slot AND f.cam_location = l.cam_location),
matched AS (SELECT * FROM paired WHERE sensor_code IS NOT NULL),
tzc AS (
  SELECT p_seen, area, weekend, time_of_day, "hour", "year", cam_location, site_id,
         count(*) AS n_zero_cam,
         sum(CASE WHEN ground_count = 0 THEN 1 ELSE 0 END)::BIGINT AS n_zero_eff
  FROM paired WHERE cam_count = 0
  GROUP BY ALL),
false_zero AS (SELECT * FROM paired WHERE ground_count > 0 AND cam_count = 0),
positive AS (SELECT * FROM paired WHERE cam_count > 0),
imp_all AS (SELECT *, NULL::INTEGER AS ground_count FROM cam WHERE "year" >= 2009),
cover AS (
  SELECT "year", site_id, count(DISTINCT julian_day) AS n_days,
         count(DISTINCT julian_day)::DOUBLE
           / (SELECT count(DISTINCT julian_day) FROM imp_all) AS share
  FROM imp_all GROUP BY "year", site_id),
imp AS (
  SELECT i.* FROM imp_all i
  WHERE EXISTS (SELECT 1 FROM cover c
                WHERE c."year" = i."year" AND c.site_id = i.site_id AND c.share >= 0.3)),
season_no AS (
  SELECT "year", site_id, row_number() OVER (ORDER BY "year", site_id)::BIGINT AS season_idx
  FROM (SELECT DISTINCT "year", site_id FROM imp)),
sdays AS (
  SELECT "year", site_id, julian_day, count(*) AS n_rows,
         count(*) FILTER (cam_count = 0) AS n_zero, count(*) FILTER (cam_count > 0) AS n_pos,
         min(obs_seq) AS first_seq
  FROM imp GROUP BY "year", site_id, julian_day),
merged AS (
  SELECT coalesce(z."year", p."year") AS "year", coalesce(z.site_id, p.site_id) AS site_id,
         coalesce(z.julian_day, p.julian_day) AS julian_day, coalesce(z.n, 0) AS n_zero,
         coalesce(p.n, 0) AS n_pos, z.o AS zero_group, p.o AS pos_group
  FROM (SELECT *, row_number() OVER (ORDER BY julian_day, "year", site_id) AS o FROM
          (SELECT "year", site_id, julian_day, count(*) AS n FROM imp WHERE cam_count = 0
           GROUP BY ALL)) z
  FULL OUTER JOIN
       (SELECT *, row_number() OVER (ORDER BY julian_day, "year", site_id) AS o FROM
          (SELECT "year", site_id, julian_day, count(*) AS n FROM imp WHERE cam_count > 0
           GROUP BY ALL)) p
  ON z."year" = p."year" AND z.site_id = p.site_id AND z.julian_day = p.julian_day),
parts AS (
  SELECT *, cam_count = 0 AS is_zero,
         count(*) OVER (PARTITION BY "year", site_id, julian_day, "hour", cam_count = 0) AS n_cam,
         row_number() OVER (PARTITION BY "year", site_id, julian_day, cam_count = 0
                            ORDER BY obs_seq)::BIGINT AS day_index
  FROM imp WHERE cam_count >= 0)
"""

GAPS = """
attrs AS (
  SELECT DISTINCT site_id, "year", area, region, access, launch, camp, resort, dist_kam, dist_van
  FROM imp),
all_pairs AS (
  SELECT a."year", a.site_id, b.site_id AS donor_site_id, abs(a.dist_kam - b.dist_kam) AS distance,
         row_number() OVER (PARTITION BY a."year", a.site_id
                            ORDER BY abs(a.dist_kam - b.dist_kam), b.site_id)::INTEGER AS donor_rank
  FROM attrs a JOIN attrs b
    ON a."year" = b."year" AND a.region = b.region AND a.access = b.access
   AND a.site_id <> b.site_id),
donor AS (SELECT * FROM all_pairs WHERE donor_rank <= 2),
given AS (
  SELECT d."year", d.site_id, d.donor_site_id, d.donor_rank, g.julian_day,
         EXISTS (SELECT 1 FROM sdays o WHERE o."year" = d."year" AND o.site_id = d.site_id
                 AND o.julian_day = g.julian_day) AS common
  FROM donor d JOIN sdays g ON g."year" = d."year" AND g.site_id = d.donor_site_id),
usable AS (
  SELECT "year", site_id, donor_site_id, donor_rank, count(*) FILTER (common) AS n_common,
         count(*) FILTER (NOT common) AS n_uncommon,
         count(*) FILTER (common) > 0 AND count(*) FILTER (NOT common) > 0 AS usable
  FROM given GROUP BY ALL),
supply AS (
  SELECT g.* FROM given g JOIN usable u USING ("year", site_id, donor_site_id)
  WHERE u.usable AND NOT g.common),
fill AS (SELECT DISTINCT "year", site_id, julian_day FROM supply)
"""


def sensor_stats(name: str, pairs: str) -> str:
    return f"""
{name} AS (
  SELECT site_id, location,
         {", ".join(f"coalesce(sum({c}), 0)::BIGINT AS {c}" for c in SUMS)}
  FROM (SELECT site_id, cam_location AS location,
          {", ".join(f"CASE WHEN {cond} THEN {value} END AS {c}" for c, (cond, value) in SUMS.items())}
        FROM {pairs}
        UNION ALL
        SELECT DISTINCT site_id, location, {", ".join("NULL" for _ in SUMS)} FROM cam)
  GROUP BY site_id, location)"""


SUMS = {
    f"{part}_{x}": (f"{cond} AND {level} = {x}", value)
    for part, cond, level, value in (
        ("false_zeros", "cam_count = 0 AND ground_count > 0", "time_of_day - 1", "1"),
        ("zero_pairs", "cam_count = 0", "time_of_day - 1", "1"),
        ("fz_ground", "cam_count = 0 AND ground_count > 0", "weekend", "ground_count"),
        ("fz_rows", "cam_count = 0 AND ground_count > 0", "weekend", "1"),
        ("pos_ground", "cam_count > 0", "weekend", "ground_count"),
        ("pos_cam", "cam_count > 0", "weekend", "cam_count"),
    )
    for x in (0, 1)
}


def modes(
    suffix: str = "", pairs: str = "matched", steps: int = 25, hyper: str | None = None
) -> str:
    """Statistics, starting hyperparameters and posterior modes; names get a suffix.

    ``hyper`` is a query to take the hyperparameters from instead.
    """
    s = suffix
    hyper = hyper or f"""
  SELECT variant, coalesce(avg(theta), 0) AS m,
         coalesce(1 / greatest(var_samp(theta), 1e-4), 1) AS p,
         coalesce(avg(beta), 0) AS m_cov,
         coalesce(1 / greatest(var_samp(beta), 1e-4), 1) AS p_cov
  FROM plug{s} GROUP BY variant"""
    variants = []
    for effect, cov, hits, size in (
        ("d", "tod", "false_zeros", "zero_pairs"),
        ("L", "wk", "fz_ground", "fz_rows"),
        ("a", "wk", "pos_ground", "pos_cam"),
    ):
        variants += [
            f"SELECT site_id, location, '{effect}' AS variant, ({hits}_0 + {hits}_1)::DOUBLE AS "
            f"hits_0, ({size}_0 + {size}_1)::DOUBLE AS size_0, 0.0::DOUBLE AS hits_1, "
            f"0.0::DOUBLE AS size_1 FROM stats{s}",
            f"SELECT site_id, location, '{effect}_{cov}', {hits}_0::DOUBLE, {size}_0::DOUBLE, "
            f"{hits}_1::DOUBLE, {size}_1::DOUBLE FROM stats{s}",
        ]
    plug = (
        "CASE WHEN variant[1] = 'd' THEN ln(({h} + 0.5) / ({n} - {h} + 0.5)) "
        "ELSE ln(({h} + 0.5) / ({n} + 0.5)) END"
    )
    p0, p1 = plug.format(h="hits_0", n="size_0"), plug.format(h="hits_1", n="size_1")

    def mu(eta: str, x: int) -> str:
        return (
            f"CASE WHEN variant[1] = 'd' THEN size_{x} / (1 + exp(-({eta}))) "
            f"ELSE size_{x} * exp({eta}) END"
        )

    def curve(eta: str, x: int) -> str:
        return (
            f"CASE WHEN variant[1] = 'd' THEN size_{x} / (1 + exp(-({eta}))) / (1 + exp({eta})) "
            f"ELSE size_{x} * exp({eta}) END"
        )

    chain = f"""
nm{s}0 AS MATERIALIZED (
  SELECT e.*, h.m, h.p, CASE WHEN contains(variant, '_') THEN h.m_cov ELSE 0 END AS mc,
         CASE WHEN contains(variant, '_') THEN h.p_cov ELSE 1 END AS pc,
         h.m AS theta, CASE WHEN contains(variant, '_') THEN h.m_cov ELSE 0 END AS beta
  FROM eft{s} e JOIN hyper{s} h USING (variant))"""
    for i in range(steps):
        chain += f""",
nd{s}{i} AS MATERIALIZED (
  SELECT *, {mu('theta', 0)} AS u0, {mu('theta + beta', 1)} AS u1,
         {curve('theta', 0)} AS c0, {curve('theta + beta', 1)} AS c1 FROM nm{s}{i}),
nm{s}{i + 1} AS MATERIALIZED (
  SELECT * EXCLUDE (theta, beta, u0, u1, c0, c1),
    theta + greatest(-1, least(1, ((c1 + pc) * (hits_0 - u0 + hits_1 - u1 - p * (theta - m))
       - c1 * (hits_1 - u1 - pc * (beta - mc))) / ((c0 + c1 + p) * (c1 + pc) - c1 * c1))) AS theta,
    beta + greatest(-1, least(1, ((c0 + c1 + p) * (hits_1 - u1 - pc * (beta - mc))
       - c1 * (hits_0 - u0 + hits_1 - u1 - p * (theta - m)))
       / ((c0 + c1 + p) * (c1 + pc) - c1 * c1))) AS beta
  FROM nd{s}{i})"""
    wide = []
    for model, (d, a, b) in {1: ("d", "L", "a"), 8: ("d_tod", "L_wk", "a_wk")}.items():
        picks = ", ".join(
            f"max({col}) FILTER (variant = '{v}') AS {e}{name}"
            for v, e in ((d, "d"), (a, "L"), (b, "a"))
            for col, name in (
                ("theta", ""), ("beta", "_cov"), ("theta_var", "_var"),
                ("beta_var", "_cov_var"), ("cov", "_cross"),
            )
        )
        wide.append(f"par{s}{model} AS (SELECT site_id, location, {picks} FROM modes{s} GROUP BY ALL)")
    return f"""{sensor_stats("stats" + s, pairs)},
eft{s} AS ({" UNION ALL ".join(variants)}),
plug{s} AS (
  SELECT site_id, location, variant, CASE WHEN size_0 > 0 THEN {p0} END AS theta,
         CASE WHEN size_0 > 0 AND size_1 > 0 THEN {p1} - ({p0}) END AS beta
  FROM eft{s}),
hyper{s} AS MATERIALIZED ({hyper}),{chain},
modes{s} AS MATERIALIZED (
  SELECT *, (c1 + pc) / det AS theta_var,
         CASE WHEN contains(variant, '_') THEN (c0 + c1 + p) / det ELSE 0 END AS beta_var,
         -c1 / det AS cov
  FROM (SELECT *, (c0 + c1 + p) * (c1 + pc) - c1 * c1 AS det
        FROM (SELECT *, {curve('theta', 0)} AS c0, {curve('theta + beta', 1)} AS c1
              FROM nm{s}{steps}))),
{", ".join(wide)}"""


MEAN = "CASE WHEN variant = 'd' THEN size_0 / (1 + exp(-t)) ELSE size_0 * exp(t) END"
CURVE = (
    "CASE WHEN variant = 'd' THEN size_0 / (1 + exp(-t)) / (1 + exp(t)) "
    "ELSE size_0 * exp(t) END"
)
#: One term of the log-likelihood that is not linear, at ``{}``.
BEND = (
    "(CASE WHEN variant = 'd' THEN greatest({0}, 0) + ln(1 + exp(-abs({0}))) ELSE exp({0}) END)"
)
LOGLIK = f"hits_0 * t - size_0 * {BEND.format('t')}"
START = """
f AS MATERIALIZED (
  SELECT variant, site_id, location, hits_0, size_0, coalesce(g.theta, 0) AS t
  FROM eft e JOIN plug g USING (variant, site_id, location) WHERE variant IN ('d', 'L', 'a'))"""


def quadrature(n: int) -> str:
    """Log of a sensor's integral by Gauss-Hermite quadrature, less Laplace's value."""
    x, w = np.polynomial.hermite.hermgauss(n)
    nodes = ", ".join(
        f"{{'x': {float(a)!r}::DOUBLE, 'w': {float(b * math.exp(a * a) / math.sqrt(math.pi))!r}::DOUBLE}}"
        for a, b in zip(x, w)
    )
    move = f"(z.x * sqrt(2.0::DOUBLE / ({CURVE} + p)))"
    gain = (
        f"hits_0 * {move} - size_0 * ({BEND.format(f'(t + {move})')} - {BEND.format('t')}) "
        f"- p * {move} * (t - m + 0.5 * {move})"
    )
    return f"ln(list_sum(list_transform([{nodes}], lambda z: z.w * exp({gain}))))"


def marginal_at(name: str, points: str, steps: int, more: str = "0") -> str:
    """CTEs ``{name}_i`` of Newton steps at the points (variant, k, m, lp), and
    ``{name}(variant, k, m, lp, total)``: the log marginal posterior there."""
    ctes = f"""
{name}_0 AS MATERIALIZED (
  SELECT f.*, q.k, q.m, q.lp, exp(q.lp) AS p FROM f JOIN {points} q USING (variant))"""
    for k in range(steps):
        ctes += f""",
{name}_{k + 1} AS MATERIALIZED (
  SELECT * EXCLUDE (mu, cu) REPLACE (t + greatest(-2, least(2, (hits_0 - mu - p * (t - m)) / (cu + p))) AS t)
  FROM (SELECT *, {MEAN} AS mu, {CURVE} AS cu FROM {name}_{k}))"""
    return ctes + f""",
{name} AS MATERIALIZED (
  SELECT variant, k, m, lp, sum({LOGLIK} + 0.5 * ln(p) - 0.5 * p * (t - m) ** 2
             - 0.5 * ln({CURVE} + p) + {more})
           - 0.5 * (m / 2.0) ** 2 - ln(2.0) - {LN2PI!r}
           + ({SHAPE} - 1) * lp - exp(lp) / {SCALE} - ({GAMMA_CONST!r}) AS total
  FROM {name}_{steps} GROUP BY variant, k, m, lp)"""


def grid_fit(levels: int = 13, points: int = 6, steps: int = 9, more: str = "0", s: str = "") -> str:
    """Maximum of the marginal of d, L and a, by a grid that narrows; by Laplace's method
    or with a correction ``more`` for each sensor.

    CTEs ending in ``best(variant, m, lp, total)``, names with a suffix; a search of
    another kind than the one it checks.
    """
    ctes = "" if s else START.strip() + ",\n"
    ctes += f"z{s}0 AS MATERIALIZED (SELECT DISTINCT variant, 0.0::DOUBLE AS m, 2.0::DOUBLE AS lp, 0.0::DOUBLE AS total FROM f)"
    for level in range(levels):
        wm, wp = 3.0 * 0.4**level / points, 6.0 * 0.4**level / points
        around = (
            f"(SELECT variant, 0 AS k, m + i * {wm!r}::DOUBLE AS m, lp + j * {wp!r}::DOUBLE AS lp "
            f"FROM z{s}{level}, range({-points}, {points + 1}) a(i), range({-points}, {points + 1}) b(j))"
        )
        ctes += "," + marginal_at(f"s{s}{level}", around, steps, more) + f""",
z{s}{level + 1} AS MATERIALIZED (
  SELECT variant, arg_max(m, total) AS m, arg_max(lp, total) AS lp, max(total) AS total
  FROM s{s}{level} GROUP BY variant)"""
    return ctes + f", best{s} AS (SELECT * FROM z{s}{levels})"


def hyper_grid() -> str:
    """CTEs from ``best`` to ``draw_at(variant, draw, k)`` and ``ngrid_40``, the modes at
    the weighted points."""
    h, step = 0.1, 0.75
    around = "(VALUES (0, 0, 0), (1, 1, 0), (2, -1, 0), (3, 0, 1), (4, 0, -1), (5, 1, 1), (6, -1, -1)) o(k, i, j)"
    value = {k: f"max(total) FILTER (k = {k})" for k in range(7)}
    two = "round({0}, 1 - floor(log10(abs({0})))::INTEGER)"
    inside = f"m BETWEEN -5 AND 5 AND lp BETWEEN {math.log(1e-4)!r} AND {math.log(1e5)!r}"
    return f"""
ncentre AS (SELECT variant, round(m, 2) AS m, round(lp, 2) AS lp FROM best),
{marginal_at("nstencil", f"(SELECT variant, k, m + {h} * i AS m, lp + {h} * j AS lp FROM ncentre, {around})", 40).strip()},
nhess AS (
  SELECT variant, -({value[1]} - 2 * {value[0]} + {value[2]}) / {h * h!r}::DOUBLE AS a,
         -({value[3]} - 2 * {value[0]} + {value[4]}) / {h * h!r}::DOUBLE AS c,
         -({value[5]} + {value[6]} - {value[1]} - {value[2]} - {value[3]} - {value[4]} + 2 * {value[0]})
           / {2 * h * h!r}::DOUBLE AS b
  FROM nstencil GROUP BY variant),
naxes AS (
  SELECT variant, {two.format("x")} AS x, {two.format("y")} AS y, {two.format("z")} AS z FROM (
    SELECT variant, sqrt(c / det) AS x, -b / det / sqrt(c / det) AS y, sqrt(a / det - b * b / det / c) AS z
    FROM (SELECT *, a * c - b * b AS det FROM nhess))),
npoints AS (
  SELECT variant, row_number() OVER (PARTITION BY variant ORDER BY i, j) - 1 AS k, m, lp FROM (
    SELECT variant, i, j, m + x * (i * {step}) AS m, lp + y * (i * {step}) + z * (j * {step}) AS lp
    FROM ncentre JOIN naxes USING (variant), range(-4, 5) a(i), range(-4, 5) b(j) WHERE i * i + j * j <= 16)
  WHERE {inside}),
{marginal_at("ngrid", "npoints", 40).strip()},
nweights AS MATERIALIZED (
  SELECT variant, k, sum(w) OVER (PARTITION BY variant ORDER BY k) AS up_to,
         k = max(k) OVER (PARTITION BY variant) AS last
  FROM (SELECT variant, k, exp(total - top) / sum(exp(total - top)) OVER (PARTITION BY variant) AS w
        FROM (SELECT *, max(total) OVER (PARTITION BY variant) AS top FROM ngrid))),
draw_at AS MATERIALIZED (
  SELECT u.variant, draw, count(up_to) FILTER (up_to < u AND NOT last) AS k
  FROM (SELECT variant, t.draw::INTEGER AS draw, {uniform(digest("'hyper'", "variant", "t.draw"), 0)} AS u
        FROM best, range(1, {N_DRAWS + 1}) t(draw)) u JOIN nweights w ON w.variant = u.variant
  GROUP BY u.variant, draw)"""


def mixed_draws() -> str:
    """The CTE ``mixed``: draws of the effects of model 1 over the weighted points."""
    rows = (
        f"(SELECT g.variant, site_id, location, draw, t, {CURVE.replace('variant', 'g.variant')} + p AS cu "
        "FROM ngrid_40 g JOIN draw_at a ON a.variant = g.variant AND a.k = g.k)"
    )
    drawn = with_normals(rows, ["variant", "site_id", "location", "draw"])
    picks = ", ".join(f"max(t + z1 / sqrt(cu)) FILTER (variant = '{e}') AS {e}, 0.0::DOUBLE AS {e}_cov" for e in "dLa")
    return f"mixed AS MATERIALIZED (SELECT draw, site_id, location, {picks} FROM ({drawn}) GROUP BY draw, site_id, location)"


def exact_cdf(cells: int = 4000) -> str:
    """CTE ``cdf(variant, site_id, location, i, x, up_to, f, slope)``: the distribution
    function of each sensor's effect by Simpson's rule on a grid around its mode."""
    move = "(x - theta)"
    density = (
        f"exp(greatest(-700, hits_0 * {move} - size_0 * ({BEND.format('x')} - {BEND.format('theta')}) "
        f"- p * {move} * (theta - m + 0.5 * {move})))"
    )

    def at_x(term: str) -> str:
        return "(" + term.replace("(t)", "(x)").replace("(-t)", "(-x)") + ")"

    slope = f"(hits_0 - {at_x(MEAN)} - p * (x - m))"
    reach = f"least(12 * sqrt(theta_var), 9.6 / sqrt(p) + abs(theta - m))"
    at = f"theta - {reach} + 2 * {reach} * i / {2 * cells}"
    return f"""
fine AS MATERIALIZED (
  SELECT *, {density} AS f, {slope} AS s, {at_x(CURVE)} + p AS c FROM (
    SELECT variant, site_id, location, hits_0, size_0, m, p, theta, i, {at} AS x, {reach} / {cells} AS h
    FROM modes, range(0, {2 * cells + 1}) t(i) WHERE NOT contains(variant, '_'))),
cells AS MATERIALIZED (
  SELECT *, lead(f, 1) OVER w AS f1, lead(f, 2) OVER w AS f2
  FROM fine WINDOW w AS (PARTITION BY variant, site_id, location ORDER BY i)),
cdf AS MATERIALIZED (
  SELECT variant, site_id, location, x, f, s, c, coalesce(sum(part) OVER (
           PARTITION BY variant, site_id, location ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           / total AS up_to, total
  FROM (SELECT *, h * (f + 4 * f1 + f2) / 3 AS part,
               sum(h * (f + 4 * f1 + f2) / 3) OVER (PARTITION BY variant, site_id, location) AS total
        FROM cells WHERE i % 2 = 0 AND f2 IS NOT NULL))"""


#: From the start of a cell on: the way to the wanted share, by the inverse's series with
#: the slope and the curvature of the log density.
EXACT = (
    "(x + (u - up_to) * total / f - 0.5 * s * ((u - up_to) * total / f) ** 2 "
    "+ (2 * s * s + c.c) / 6 * ((u - up_to) * total / f) ** 3)"
)


def digest(*keys: str) -> str:
    return f"md5(concat_ws('|', '{SEED}', {', '.join(keys)}))"


def uniform(hexa: str, lane: int) -> str:
    return f"((('0x' || substr({hexa}, {1 + 13 * lane}, 13))::BIGINT + 0.5::DOUBLE) / {1 << 52}::DOUBLE)"


def with_normals(source: str, keys: list[str], out: str = "z") -> str:
    """``source`` with two standard normal columns made from the keys."""
    h = digest(*keys)
    return (
        f"SELECT *, sqrt(-2 * ln(_u1)) * cos(2 * pi() * _u2) AS {out}1, "
        f"sqrt(-2 * ln(_u1)) * sin(2 * pi() * _u2) AS {out}2 FROM ("
        f"SELECT *, {uniform(h, 0)} AS _u1, {uniform(h, 1)} AS _u2 FROM {source})"
    )


def param_draws(params: str, n: int) -> str:
    """Draws of a model's effects as a subquery."""
    q = f"(SELECT p.*, t.draw::INTEGER AS draw FROM {params} p, range(1, {n + 1}) t(draw))"
    for e in ("d", "L", "a"):
        q = f"({with_normals(q, [repr(e), 'site_id', 'location', 'draw'], 'z' + e)})"
        q = q.replace("SELECT *, sqrt", "SELECT * EXCLUDE (_u1, _u2), sqrt", 1)
    cols = []
    for e in ("d", "L", "a"):
        cols.append(f"{e} + sqrt({e}_var) * z{e}1 AS {e}")
        cols.append(
            f"CASE WHEN {e}_cov_var > 0 THEN {e}_cov + {e}_cross / sqrt({e}_var) * z{e}1 + "
            f"sqrt(greatest({e}_cov_var - {e}_cross * {e}_cross / {e}_var, 0)) * z{e}2 "
            f"ELSE 0 END AS {e}_cov"
        )
    return (
        f"(SELECT ((draw - 1) % 2 + 1)::INTEGER AS chain, draw, site_id, location, "
        f"{', '.join(cols)} FROM {q})"
    )


IMPUTE = """
grp AS (
  SELECT "year", site_id, julian_day, location, time_of_day, weekend, p_seen, is_zero, n_cam,
         count(*) AS n_rows, sum(cam_count)::BIGINT AS cam_sum
  FROM parts GROUP BY ALL)
"""


def expected(groups: str, params: str, mode: str = "none") -> str:
    logit = "(d + d_cov * (time_of_day - 1))"
    if mode == "logit":
        logit += " * p_seen"
    delta = f"1 / (1 + exp(-({logit})))" + (" * p_seen" if mode == "prob" else "")
    return f"""(
  SELECT *, CASE WHEN is_zero THEN n_rows * delta * lam / n_cam
                 ELSE alpha * cam_sum / n_cam END AS effort,
         CASE WHEN is_zero THEN n_rows * (delta * lam * (1 + lam) - (delta * lam) ** 2) / n_cam ** 2
              ELSE alpha * cam_sum / n_cam ** 2 END AS effort_var
  FROM (SELECT g.*, {delta} AS delta, exp(L + L_cov * weekend) AS lam,
               exp(a + a_cov * weekend) AS alpha
        FROM {groups} g JOIN {params} p USING (site_id, location)))"""


ROWS = "(SELECT *, 1 AS n_rows, cam_count AS cam_sum FROM parts)"
DAILY = """
daily AS MATERIALIZED (
  SELECT "year", site_id, julian_day,
         coalesce(sum(effort) FILTER (is_zero), 0) AS zero_effort,
         coalesce(sum(effort) FILTER (NOT is_zero), 0) AS pos_effort,
         sum(effort) AS effort
  FROM {} GROUP BY "year", site_id, julian_day)"""


def filled(daily: str, by: str = "") -> str:
    """Effort of fill days, averaged over donors; ``by`` is '' or 'draw, '."""
    same = " AND o.draw = g.draw" if by else ""
    return f"""
ratio AS (
  SELECT {by.replace('draw', 'g.draw')}v."year", v.site_id, v.donor_site_id,
         sum(o.effort) / nullif(sum(g.effort), 0) AS r
  FROM given v
  JOIN {daily} g ON g."year" = v."year" AND g.site_id = v.donor_site_id AND g.julian_day = v.julian_day
  JOIN {daily} o ON o."year" = v."year" AND o.site_id = v.site_id AND o.julian_day = v.julian_day{same}
  WHERE v.common GROUP BY ALL),
filled AS (
  SELECT {by.replace('draw', 'g.draw')}s."year", s.site_id, s.julian_day, avg(g.effort * r.r) AS effort
  FROM supply s
  JOIN {daily} g ON g."year" = s."year" AND g.site_id = s.donor_site_id AND g.julian_day = s.julian_day
  JOIN ratio r ON r."year" = s."year" AND r.site_id = s.site_id
   AND r.donor_site_id = s.donor_site_id{same.replace('o.', 'r.')}
  WHERE r.r IS NOT NULL GROUP BY ALL),
annual AS (
  SELECT {by}"year", site_id, sum(o) AS observed_effort, sum(f) AS filled_effort,
         count(*) AS n_days, sum(o) + sum(f) AS effort
  FROM (SELECT {by}"year", site_id, effort AS o, 0.0::DOUBLE AS f FROM {daily}
        UNION ALL SELECT {by}"year", site_id, 0.0::DOUBLE, effort FROM filled)
  GROUP BY ALL)"""


def counts(groups: str, params: str, keys: list[str], n: int | None) -> str:
    """Drawn counts of groups: CTEs ending in ``drawn`` with ``draw`` and ``effort``.

    Distribution functions are tabulated with lgamma and searched by counting.
    """
    repeat = f", range(1, {n + 1}) t(draw)" if n else ""
    draw = "t.draw::INTEGER AS draw, " if n else "p.draw, "
    h = digest("is_zero::INTEGER", *keys, "draw")
    return f"""
g0 AS MATERIALIZED (
  SELECT *, {uniform('hx', 0)} AS u1, {uniform('hx', 1)} AS u2 FROM (
    SELECT *, {h} AS hx FROM (
      SELECT g.*, {draw} 1 / (1 + exp(-(d + d_cov * (time_of_day - 1)))) AS delta,
             exp(L + L_cov * weekend) AS lam, exp(a + a_cov * weekend) AS alpha
      FROM {groups} g JOIN {params} p USING (site_id, location){repeat}))),
bcdf AS MATERIALIZED (
  SELECT n_rows, delta, k, sum(exp(lgamma(n_rows + 1) - lgamma(k + 1) - lgamma(n_rows - k + 1)
           + k * ln(delta) + (n_rows - k) * ln(1 - delta)))
         OVER (PARTITION BY n_rows, delta ORDER BY k) AS cdf
  FROM (SELECT n_rows, delta, unnest(range(0, n_rows)) AS k
        FROM (SELECT DISTINCT n_rows, delta FROM g0 WHERE is_zero))),
g1 AS MATERIALIZED (
  SELECT g0.*, CASE WHEN is_zero THEN coalesce(b.hits, 0) * lam ELSE alpha * cam_sum END AS mu
  FROM g0 LEFT JOIN (
    SELECT hx, count(*) AS hits FROM g0 JOIN bcdf c
      ON c.n_rows = g0.n_rows AND c.delta = g0.delta AND g0.u1 > c.cdf
    WHERE is_zero GROUP BY hx) b ON b.hx = g0.hx),
pcdf AS MATERIALIZED (
  SELECT mu, k, sum(exp(-mu + k * ln(mu) - lgamma(k + 1))) OVER (PARTITION BY mu ORDER BY k) AS cdf
  FROM (SELECT mu, unnest(range(0, (mu + 12 * sqrt(mu) + 25)::BIGINT)) AS k
        FROM (SELECT DISTINCT mu FROM g1 WHERE mu > 0))),
drawn AS MATERIALIZED (
  SELECT g1.*, coalesce(c.cnt, 0) / n_cam::DOUBLE AS effort
  FROM g1 LEFT JOIN (
    SELECT hx, count(*) AS cnt FROM g1 JOIN pcdf c ON c.mu = g1.mu AND g1.u2 > c.cdf
    GROUP BY hx) c ON c.hx = g1.hx),
ddraws AS MATERIALIZED (
  SELECT draw, "year", site_id, julian_day,
         coalesce(sum(effort) FILTER (is_zero), 0) AS zero_effort,
         coalesce(sum(effort) FILTER (NOT is_zero), 0) AS pos_effort, sum(effort) AS effort
  FROM drawn GROUP BY draw, "year", site_id, julian_day)"""


def rounded(source: str, doubles: list[str], keep: str, digits: int = 6) -> str:
    r = ", ".join(f'round({c}, {digits}) + 0.0 AS {c.split(".")[-1]}' for c in doubles)
    return f"SELECT {keep}, {r} FROM {source}"


def sql(*parts: str) -> str:
    *ctes, last = parts
    return "WITH " + ",\n".join([RAW.strip(), *[c.strip() for c in ctes]]) + "\n" + last


GRP_KEYS = ['"year"', "site_id", "julian_day", "location", "time_of_day", "weekend", "n_cam"]
VALID = """
valid AS (
  SELECT m.* FROM matched m
  WHERE {u} >= 0.8::DOUBLE AND cam_count IS NOT NULL AND ground_count IS NOT NULL),
train AS (SELECT * FROM matched WHERE {u} < 0.8::DOUBLE),
vrows AS (
  SELECT * EXCLUDE (location, cam_location), cam_location AS location, cam_count = 0 AS is_zero,
         1 AS n_rows, cam_count AS cam_sum,
         count(*) OVER (PARTITION BY "year", site_id, julian_day, "hour", cam_count = 0) AS n_cam
  FROM valid)""".format(u=uniform(digest("obs_seq", "cam_location"), 0))
LN2PI = 0.5 * math.log(2 * math.pi)
SHAPE, SCALE = 0.001, 1000.0
GAMMA_CONST = math.lgamma(SHAPE) + SHAPE * math.log(SCALE)

LOGPOST = """
rowll AS (
  SELECT t.site_id, cam_location AS location, 'zero' AS part,
         lgamma(n_zero_cam + 1) - lgamma(n_zero_eff + 1) - lgamma(n_zero_cam - n_zero_eff + 1)
         + n_zero_eff * ln(1 / (1 + exp(d))) + (n_zero_cam - n_zero_eff) * ln(1 / (1 + exp(-d))) AS ll
  FROM tzc t JOIN par1 p ON p.site_id = t.site_id AND p.location = t.cam_location
  UNION ALL
  SELECT f.site_id, cam_location, 'false_zero', ground_count * L - exp(L) - lgamma(ground_count + 1)
  FROM false_zero f JOIN par1 p ON p.site_id = f.site_id AND p.location = f.cam_location
  UNION ALL
  SELECT f.site_id, cam_location, 'positive', ground_count * (a + ln(cam_count))
         - cam_count * exp(a) - lgamma(ground_count + 1)
  FROM positive f JOIN par1 p ON p.site_id = f.site_id AND p.location = f.cam_location),
persensor AS (
  SELECT q.site_id, q.location,
         coalesce((SELECT sum(ll) FROM rowll r WHERE r.site_id = q.site_id AND r.location = q.location AND part = 'zero'), 0) AS zero,
         coalesce((SELECT sum(ll) FROM rowll r WHERE r.site_id = q.site_id AND r.location = q.location AND part = 'false_zero'), 0) AS false_zero,
         coalesce((SELECT sum(ll) FROM rowll r WHERE r.site_id = q.site_id AND r.location = q.location AND part = 'positive'), 0) AS positive,
         (SELECT sum(0.5 * ln(h.p) - {ln2pi} - 0.5 * h.p * (CASE h.variant WHEN 'd' THEN q.d WHEN 'L' THEN q.L ELSE q.a END - h.m) ** 2)
          FROM hyper h WHERE h.variant IN ('d', 'L', 'a')) AS log_prior
  FROM par1 q)""".replace("{ln2pi}", repr(LN2PI))

MEMBERS = ", ".join(
    f"({m}, '{v}')"
    for m, vs in {
        1: "d L a", 2: "d L a_wk", 3: "d L_wk a", 4: "d_tod L a",
        5: "d L_wk a_wk", 6: "d_tod L a_wk", 7: "d_tod L_wk a", 8: "d_tod L_wk a_wk",
    }.items()
    for v in vs.split()
)
DIC = f"""
edraws AS (
  SELECT *, theta + sqrt(theta_var) * z1 AS t,
         CASE WHEN contains(variant, '_') THEN beta + cov / sqrt(theta_var) * z1
           + sqrt(greatest(beta_var - cov * cov / theta_var, 0)) * z2 ELSE 0 END AS b
  FROM ({with_normals(f"(SELECT m.*, t.draw::INTEGER AS draw FROM modes m, range(1, {N_DRAWS + 1}) t(draw))", ["variant", "site_id", "location", "draw"])})),
dev AS (
  SELECT variant, draw, -2 * sum(
    CASE WHEN variant[1] = 'd' THEN hits_0 * t - size_0 * ln(1 + exp(t))
           + hits_1 * (t + b) - size_1 * ln(1 + exp(t + b))
         ELSE hits_0 * t - size_0 * exp(t) + hits_1 * (t + b) - size_1 * exp(t + b) END) AS deviance
  FROM edraws GROUP BY variant, draw),
const AS (
  SELECT (SELECT sum(lgamma(n_zero_cam + 1) - lgamma(n_zero_eff + 1)
                     - lgamma(n_zero_cam - n_zero_eff + 1)) FROM tzc)
       - (SELECT sum(lgamma(ground_count + 1)) FROM false_zero)
       + (SELECT sum(ground_count * ln(cam_count) - lgamma(ground_count + 1)) FROM positive) AS c),
dic AS (
  SELECT model, avg(deviance) - 2 * (SELECT c FROM const) AS mean_deviance,
         var_samp(deviance) / 2 AS p_effective,
         avg(deviance) - 2 * (SELECT c FROM const) + var_samp(deviance) / 2 AS dic
  FROM (SELECT model, draw, sum(deviance) AS deviance
        FROM dev JOIN (VALUES {MEMBERS}) v(model, variant) USING (variant)
        GROUP BY model, draw)
  GROUP BY model)"""

IMP_ROWS = "SELECT * FROM imp"
PAIR_DRAWS = param_draws("par8", N_DRAWS)
LONG3 = (
    "(SELECT chain, draw, site_id, location, unnest(['d', 'L', 'a']) AS param, "
    "unnest([d, L, a]) AS value FROM " + param_draws("par8", 40) + ")"
)
NEW = with_normals(
    f"(SELECT h.*, t.draw::INTEGER AS draw FROM hyper h, range(1, {N_DRAWS + 1}) t(draw))",
    ["'new'", "variant", "draw"],
)


def density(source: str, keys: str, end: float) -> str:
    """Kernel density of ``value`` in ``source`` on 512 points from 0 to ``end``."""
    return f"""
src AS MATERIALIZED ({source}),
width AS (
  SELECT {keys}, 0.9 * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34)
           WHEN sd > 0 THEN sd WHEN size > 0 THEN size ELSE 1 END * n ** -0.2 AS w
  FROM (SELECT {keys}, stddev_samp(value) AS sd, abs(arg_min(value, draw)) AS size, count(*) AS n,
               quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr
        FROM src GROUP BY ALL)),
dens AS (
  SELECT {keys}, i::INTEGER AS i, i * ({end!r}::DOUBLE / 511) AS x,
         avg(exp(-0.5 * ((i * ({end!r}::DOUBLE / 511) - value) / w) ** 2) / (w * sqrt(2 * pi()))) AS density
  FROM src JOIN width USING ({keys}), range(0, 512) t(i) GROUP BY ALL)"""


def _oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    raw_cols = "* EXCLUDE (obs_seq)"
    o["s1_read_observations"] = sql(f"SELECT {raw_cols} FROM raw_obs")
    o["s1_read_observations_parquet"] = sql("SELECT * FROM raw_obs")
    o["s2_read_sites"] = sql("SELECT * FROM raw_sites")
    o["s3_write_and_read_stage"] = sql("SELECT * FROM cam")
    o["s4_export_csv"] = sql("SELECT * FROM cam")
    o["p1_dedup_rows"] = sql("SELECT * FROM dedup")
    o["p2_normalize_observations"] = sql("SELECT * FROM norm")
    o["p3_normalize_sites"] = sql("SELECT * FROM site_norm")
    o["p4_assign_site_ids"] = sql("SELECT * FROM site_ids")
    o["p5_exclude_sites"] = sql("SELECT * FROM norm WHERE name NOT IN ('NATION_7', 'NATION_9')")
    o["p6_add_keys"] = sql("SELECT * FROM eff")
    o["p7_ground_rows"] = sql("SELECT * FROM gr")
    o["p7_camera_rows"] = sql("SELECT * FROM cam")
    o["p8_positive_pairs"] = sql("SELECT * FROM positive")
    o["p9_false_zeros"] = sql("SELECT * FROM false_zero")
    o["p10_imputation_rows"] = sql("SELECT * FROM imp_all")
    o["p11_restrict_to"] = sql(IMP_ROWS + ' WHERE "year" = 2010 AND site_id = 6')
    o["p12_add_day_keys"] = sql(
        'SELECT obs_seq, location, season_idx, 1000 * season_idx + julian_day AS season_day_code, '
        '100000 * julian_day + 1000 * "hour" + season_idx AS day_hour_season_code '
        'FROM imp JOIN season_no USING ("year", site_id)'
    )
    o["p13_zero_part"] = sql(IMP_ROWS + " WHERE cam_count = 0")
    o["p13_positive_part"] = sql(IMP_ROWS + " WHERE cam_count > 0")
    cov = "obs_seq, cam_location, time_of_day - 1 AS afternoon, weekend"
    o["p14_covariate_columns"] = sql(
        f"SELECT 'false_zero' AS part, {cov} FROM false_zero "
        f"UNION ALL SELECT 'positive', {cov} FROM positive"
    )
    u = uniform(digest("obs_seq", "cam_location"), 0)
    o["p16_training_pairs"] = sql(f"SELECT * FROM paired WHERE {u} < 0.8::DOUBLE")
    o["p16_validation_pairs"] = sql(
        f"SELECT * FROM paired WHERE {u} >= 0.8::DOUBLE AND cam_count IS NOT NULL "
        "AND ground_count IS NOT NULL"
    )
    o["j1_join_sites"] = sql("SELECT * FROM joined")
    o["j2_pair_counts"] = sql("SELECT * FROM paired")
    o["j2_matched_pairs"] = sql("SELECT * FROM matched")
    o["j3_match_index"] = sql(
        'SELECT f.obs_seq, f.cam_location, f."year", f.site_id, s.season_idx FROM false_zero f '
        'LEFT JOIN season_no s ON s."year" = f."year" AND s.site_id = f.site_id'
    )
    o["j4_known_sensors_only"] = sql(
        "SELECT i.* FROM imp_all i WHERE EXISTS (SELECT 1 FROM false_zero f "
        "WHERE f.site_id = i.site_id AND f.cam_location = i.location)"
    )
    o["j5_merge_daily"] = sql("SELECT * FROM merged")
    o["j6_align_p_seen"] = sql(
        "SELECT sensor_idx, site_id, location, p_seen FROM (SELECT site_id, location, "
        "row_number() OVER (ORDER BY site_id, location)::BIGINT AS sensor_idx FROM "
        "(SELECT DISTINCT site_id, cam_location AS location FROM false_zero)) "
        "JOIN (SELECT DISTINCT site_id, location, p_seen FROM cam) USING (site_id, location)"
    )
    o["j7_similar_seasons"] = sql(GAPS, "SELECT * FROM donor")
    o["j8_compare_fits"] = sql(
        modes(),
        'SELECT variant, site_id, location, round(m.theta, 6) + 0.0 AS "first", '
        'round(p.theta, 6) + 0.0 AS "second", round(m.theta - p.theta, 6) + 0.0 AS difference '
        "FROM modes m FULL OUTER JOIN plug p USING (variant, site_id, location)",
    )
    o["a1_true_zero_counts"] = sql("SELECT * FROM tzc")
    o["a1_true_zero_counts_by_season"] = sql(
        'SELECT area, weekend, time_of_day, "hour", "year", cam_location, site_id, season_code, '
        "count(*) AS n_zero_cam, count(*) FILTER (ground_count = 0) AS n_zero_eff "
        "FROM matched WHERE cam_count = 0 GROUP BY ALL"
    )
    o["a1_true_false_zeros_by_hour"] = sql(
        'SELECT site_id, cam_location, "hour", count(*) AS n_zero_cam, '
        "count(*) FILTER (ground_count = 0) AS n_zero_eff, "
        "count(*) FILTER (ground_count > 0) AS n_false_zero "
        "FROM matched WHERE cam_count = 0 GROUP BY ALL"
    )
    o["a2_days_total"] = sql("SELECT count(DISTINCT julian_day) AS n_days_total FROM imp_all")
    o["a3_season_coverage"] = sql(rounded("cover", ["share"], '"year", site_id, n_days'))
    o["a4_drop_low_coverage"] = sql(IMP_ROWS)
    o["a4_drop_low_coverage_pairs"] = sql(
        'SELECT m.* FROM matched m JOIN cover c USING ("year", site_id) WHERE c.share >= 0.3'
    )
    day = '"year", site_id, julian_day'
    o["a5_obs_per_day"] = sql(
        f"SELECT {day}, CASE WHEN cam_count = 0 THEN 'zero' ELSE 'positive' END AS part, "
        "count(*) AS n_obs FROM imp WHERE cam_count >= 0 GROUP BY ALL"
    )
    o["a6_days_per_season"] = sql(
        'SELECT "year", site_id, count(DISTINCT julian_day) AS n_days FROM imp GROUP BY ALL'
    )
    o["a6_day_range"] = sql(
        "SELECT count(DISTINCT julian_day) AS n_days, max(julian_day) AS max_day FROM imp"
    )
    o["a7_sensor_p_seen"] = sql("SELECT DISTINCT site_id, location, p_seen FROM cam")
    o["a8_sensor_stats"] = sql(sensor_stats("stats", "matched"), "SELECT * FROM stats")
    here = '"year" = 2010 AND site_id = 6'
    season_sums = {
        c: f"sum(CASE WHEN {cond}{'' if c[:4] in ('fals', 'zero') else ' AND ' + here} "
        f"THEN {value} ELSE 0 END)::BIGINT AS {c}"
        for c, (cond, value) in SUMS.items()
    }
    o["a8_sensor_stats_one_season"] = sql(
        f"SELECT site_id, location, {', '.join(f'coalesce({c}, 0) AS {c}' for c in SUMS)} FROM "
        "(SELECT DISTINCT site_id, location FROM cam) LEFT JOIN "
        f"(SELECT site_id, cam_location AS location, {', '.join(season_sums.values())} "
        "FROM matched GROUP BY ALL) USING (site_id, location)"
    )
    # Read from the cells of the statistics stage, the same results.
    for name in (
        "a1_true_zero_counts", "a1_true_zero_counts_by_season", "a8_sensor_stats", "a8_sensor_stats_one_season",
    ):
        o[f"{name}_from_cells"] = o[name]
    cell_sums = {
        "n_pairs": "true", "zero_rows": "cam_count = 0",
        "zero_known": "cam_count = 0 AND ground_count IS NOT NULL",
        "true_zeros": "cam_count = 0 AND ground_count = 0",
        "false_zeros": "cam_count = 0 AND ground_count > 0",
    }
    counted = ", ".join(f"count(*) FILTER ({rows}) AS {c}" for c, rows in cell_sums.items())
    o["a8_pair_cells"] = sql(
        'SELECT p_seen, area, weekend, time_of_day, "hour", "year", cam_location, site_id, season_code, '
        f"{counted}, coalesce(sum(ground_count) FILTER (cam_count = 0 AND ground_count > 0), 0)::BIGINT AS fz_ground, "
        "coalesce(sum(ground_count) FILTER (cam_count > 0), 0)::BIGINT AS pos_ground, "
        "coalesce(sum(cam_count) FILTER (cam_count > 0 AND ground_count IS NOT NULL), 0)::BIGINT AS pos_cam, "
        "round(coalesce(sum(CASE WHEN cam_count > 0 THEN ground_count * ln(cam_count) ELSE 0 END "
        "- lgamma(ground_count + 1)) FILTER (cam_count > 0 OR ground_count > 0), 0), 4) + 0.0 AS log_counts "
        "FROM matched GROUP BY ALL"
    )
    profile = [
        ("zero_pairs", "tzc", "cam_location"), ("false_zero", "false_zero", "cam_location"),
        ("positive", "positive", "cam_location"),
        ("imputation_zero", "(SELECT * FROM imp WHERE cam_count = 0)", "location"),
        ("imputation_positive", "(SELECT * FROM imp WHERE cam_count > 0)", "location"),
    ]
    o["a10_partition_profile"] = sql(
        " UNION ALL ".join(
            f"SELECT '{n}' AS part, count(*) AS n_rows, count(DISTINCT (site_id, {loc})) AS n_sensors"
            f" FROM {t}"
            for n, t, loc in profile
        )
    )
    o["a11_table_summary"] = sql(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", min({c})::DOUBLE AS \"min\", "
            f"round(quantile_cont({c}::DOUBLE, 0.25), 6) AS q1, "
            f"round(quantile_cont({c}::DOUBLE, 0.5), 6) AS \"median\", "
            f"round(avg({c}), 6) AS \"mean\", round(quantile_cont({c}::DOUBLE, 0.75), 6) AS q3, "
            f"max({c})::DOUBLE AS \"max\", count(*) - count({c}) AS n_null, count(*) AS n_rows "
            "FROM imp_all"
            for c in ("cam_count", '"hour"', "julian_day", '"year"', "dist_kam", "p_seen", "ground_count")
        ).replace("'\"hour\"'", "'hour'").replace("'\"year\"'", "'year'")
    )
    o["a11_unmatched_keys"] = sql(
        f"SELECT {day}, location, CASE WHEN g.n IS NULL THEN 0 ELSE 1 END AS in_left, "
        "CASE WHEN c.n IS NULL THEN 0 ELSE 1 END AS in_right FROM "
        f"(SELECT {day}, location, count(*) AS n FROM gr GROUP BY ALL) g FULL OUTER JOIN "
        f"(SELECT {day}, location, count(*) AS n FROM cam GROUP BY ALL) c "
        f"USING ({day}, location) WHERE g.n IS NULL OR c.n IS NULL"
    )
    o["w1_sensors_per_slot"] = sql("SELECT obs_seq, location, n_cam FROM parts")
    o["w2_day_index"] = sql("SELECT obs_seq, location, day_index FROM parts")
    o["w3_reindex_seasons"] = sql("SELECT * FROM season_no")
    number = "row_number() OVER (ORDER BY site_id, location)::BIGINT AS sensor_idx"
    o["w4_sensor_dictionary"] = sql(
        f"SELECT site_id, location, {number} FROM (SELECT site_id, cam_location AS location FROM "
        "matched WHERE cam_count >= 0 UNION SELECT site_id, location FROM imp)"
    )
    o["w4_sensor_dictionary_calibration"] = sql(
        f"SELECT site_id, location, {number} FROM (SELECT DISTINCT site_id, "
        "cam_location AS location FROM matched WHERE cam_count >= 0)"
    )
    o["w4_sensor_dictionary_positive"] = sql(
        f"SELECT site_id, location, {number} FROM "
        "(SELECT DISTINCT site_id, cam_location AS location FROM positive)"
    )
    o["w5_group_ordinal"] = sql(
        "SELECT obs_seq, location, CASE WHEN cam_count = 0 THEN zero_group ELSE pos_group END AS "
        f"group_ordinal FROM imp JOIN merged USING ({day}) WHERE cam_count >= 0"
    )
    o["t1_ordering"] = sql(
        'SELECT "year", site_id, obs_seq, location, julian_day, cam_count FROM imp '
        "ORDER BY 1, 2, 3, 4"
    )
    o["t2_nearest_three"] = sql(GAPS, "SELECT * FROM all_pairs WHERE donor_rank <= 3")
    dic_out = rounded("dic", ["mean_deviance", "p_effective", "dic"], "model", 4)
    o["t3_best_model"] = sql(modes(), DIC, dic_out + " WHERE dic = (SELECT min(dic) FROM dic)")
    o["u1_pairings_by_location"] = sql(
        "SELECT cam_location, count(*) AS n_rows, count(cam_count) AS n_matched "
        "FROM paired GROUP BY cam_location"
    )
    pair_day = '"year", site_id, donor_site_id, donor_rank, julian_day'
    o["u2_common_days"] = sql(GAPS, f"SELECT {pair_day} FROM given WHERE common")
    o["u3_uncommon_days"] = sql(GAPS, f"SELECT {pair_day} FROM given WHERE NOT common")
    active = (
        f"(SELECT {day}, false AS filled FROM sdays UNION ALL SELECT {day}, true FROM fill)"
    )
    o["u4_active_days"] = sql(GAPS, f"SELECT * FROM {active}")
    o["u4_active_day_counts"] = sql(
        GAPS, f'SELECT "year", site_id, count(*) AS n_active FROM {active} GROUP BY ALL'
    )
    o["r1_season_day_list"] = sql(
        'SELECT "year", site_id, row_number() OVER (PARTITION BY "year", site_id '
        "ORDER BY first_seq)::INTEGER AS k, julian_day FROM sdays"
    )
    o["r2_season_day_calendar"] = sql(
        f"SELECT {day}, coalesce(n_zero, 0) AS n_zero, coalesce(n_pos, 0) AS n_pos FROM "
        '(SELECT * FROM (SELECT DISTINCT "year", site_id FROM imp), '
        "(SELECT unnest(range((SELECT min(julian_day) FROM imp), "
        "(SELECT max(julian_day) FROM imp) + 1))::INTEGER AS julian_day)) "
        f"LEFT JOIN sdays USING ({day})"
    )

    # model
    o["m1_log_posterior"] = sql(
        modes(), LOGPOST,
        rounded("persensor", ["zero", "false_zero", "positive", "log_prior"], "site_id, location"),
    )
    hyper_prior = (
        f"(SELECT sum(-{LN2PI!r} - ln(2.0) - 0.5 * (m / 2.0) ** 2 + ({SHAPE} - 1) * ln(p) "
        f"- p / {SCALE} - ({GAMMA_CONST!r})) FROM hyper WHERE variant IN ('d', 'L', 'a'))"
    )
    o["m1_total_log_posterior"] = sql(
        modes(), LOGPOST,
        "SELECT round(ll, 4) AS log_likelihood, round(pr, 4) AS log_prior, "
        "round(hp, 4) AS log_hyper_prior, round(ll + pr + hp, 4) AS log_posterior FROM "
        "(SELECT sum(zero + false_zero + positive) AS ll, sum(log_prior) AS pr, "
        f"any_value({hyper_prior}) AS hp FROM persensor)",
    )
    o["m2_fit_hierarchical"] = sql(
        modes(steps=1), grid_fit(),
        "SELECT variant, round(m, 3) + 0.0 AS m, round(lp, 2) + 0.0 AS log_p, "
        "round(total, 4) AS log_marginal, true AS converged FROM best",
    )
    o["m3_modes_covariates"] = sql(
        modes(),
        rounded("modes", ["theta", "beta", "theta_var", "beta_var", "cov"],
                "variant, site_id, location"),
    )
    se = [
        ("d", "d"), ("L", "L"), ("a", "a"), ("sqrt(d_var)", "d_se"), ("sqrt(L_var)", "L_se"),
        ("sqrt(a_var)", "a_se"), ("1 / (1 + exp(-d))", "p_false_zero"),
        ("1 / (1 + exp(d))", "p_true_zero"),
        ("sqrt(d_var) / (1 + exp(-d)) / (1 + exp(d))", "p_zero_se"),
        ("exp(L)", "false_zero_mean"), ("exp(L) * sqrt(L_var)", "false_zero_mean_se"),
        ("exp(a)", "multiplier"), ("exp(a) * sqrt(a_var)", "multiplier_se"),
    ]
    o["m4_standard_errors"] = sql(
        modes(),
        "SELECT site_id, location, "
        + ", ".join(f"round({x}, 6) + 0.0 AS {n}" for x, n in se) + " FROM par1",
    )
    o["m4_positive_mean_errors"] = sql(
        modes(),
        "SELECT obs_seq, cam_location, round(cam_count * exp(a), 6) AS mean, "
        "round(cam_count * exp(a) * sqrt(a_var), 6) AS mean_se FROM positive f "
        "JOIN par1 p ON p.site_id = f.site_id AND p.location = f.cam_location",
    )
    six = ["d", "d_cov", "L", "L_cov", "a", "a_cov"]
    who = "chain, draw, site_id, location"
    o["m5_draw_parameters"] = sql(modes(), rounded(PAIR_DRAWS, six, who))
    o["m6_thin_draws"] = sql(
        modes(),
        rounded(param_draws("par1", N_DRAWS), six, who) + " WHERE draw > 6 AND (draw - 6) % 2 = 0",
    )
    o["m7_model_dic"] = sql(modes(), DIC, dic_out)
    o["m7_log_constant"] = sql(modes(), DIC, "SELECT round(c, 4) + 0.0 AS log_constant FROM const")
    new_cols = (
        "variant, draw, m + z1 / sqrt(p) AS theta, "
        "CASE WHEN contains(variant, '_') THEN m_cov + z2 / sqrt(p_cov) ELSE 0 END AS beta"
    )
    new_effects = (
        "(SELECT variant, m AS theta_mean, 1 / sqrt(p) AS theta_sd, "
        "m + CASE WHEN contains(variant, '_') THEN m_cov ELSE 0 END AS both_mean, "
        "sqrt(1 / p + CASE WHEN contains(variant, '_') THEN 1 / p_cov ELSE 0 END) AS both_sd FROM hyper)"
    )
    o["m8_new_sensor_effects"] = sql(
        modes(), rounded(new_effects, ["theta_mean", "theta_sd", "both_mean", "both_sd"], "variant")
    )

    # imputation
    gcols = f"{day}, location, time_of_day, weekend, is_zero, n_cam, n_rows"
    both = ["effort", "effort_var"]
    o["i1_expected_effort"] = sql(modes(), IMPUTE, rounded(expected("grp", "par1"), both, gcols))
    o["i1_expected_effort_covariates"] = sql(
        modes(), IMPUTE, rounded(expected("grp", "par8", "logit"), both, gcols)
    )
    o["i1_expected_effort_by_row"] = sql(
        modes(), rounded(expected(ROWS, "par1", "prob"), both, "obs_seq, location")
    )
    daily = DAILY.format(expected("grp", "par1"))
    three = ["zero_effort", "pos_effort", "effort"]
    o["a9_sum_effort_daily"] = sql(modes(), IMPUTE, daily, rounded("daily", three, day))
    row_keys = ["obs_seq", "location"]
    row_counts = counts(ROWS, "par1", row_keys, 3)
    row_out = rounded("drawn", ["effort"], "obs_seq, location, draw")
    o["i2_impute_zero_rows"] = sql(modes(), row_counts, row_out + " WHERE is_zero")
    o["i3_impute_positive_rows"] = sql(modes(), row_counts, row_out + " WHERE NOT is_zero")
    row_counts = counts(ROWS, "par1", row_keys, N_DRAWS)
    o["i2_impute_zero_rows_all_draws"] = sql(modes(), row_counts, row_out + " WHERE is_zero")
    o["i3_impute_positive_rows_all_draws"] = sql(modes(), row_counts, row_out + " WHERE NOT is_zero")
    gdraws = counts("grp", "par1", GRP_KEYS, N_DRAWS)
    o["i4_effort_draws"] = sql(modes(), IMPUTE, gdraws, rounded("ddraws", three, "draw, " + day))
    o["i4_effort_draws_with_parameters"] = sql(
        modes(), IMPUTE, counts("grp", param_draws("par1", N_DRAWS), GRP_KEYS, None),
        rounded("ddraws", three, "draw, " + day),
    )
    o["i5_effort_intervals"] = sql(
        modes(), IMPUTE, gdraws,
        f"SELECT {day}, round(avg(effort), 6) AS mean, round(stddev_samp(effort), 6) AS sd, "
        "round(quantile_cont(effort, 0.025), 6) AS low, round(quantile_cont(effort, 0.5), 6) AS "
        f"median, round(quantile_cont(effort, 0.975), 6) AS high FROM ddraws GROUP BY {day}",
    )
    yearly = ["observed_effort", "filled_effort", "effort"]
    o["i6_effort_annual"] = sql(
        modes(), IMPUTE, daily, GAPS, filled("daily"),
        rounded("annual", yearly, '"year", site_id, n_days'),
    )
    fitted = modes(
        "f", hyper="SELECT variant, m, exp(lp) AS p, 0.0::DOUBLE AS m_cov, 1.0::DOUBLE AS p_cov FROM best"
    )
    o["i6_effort_annual_fitted"] = sql(
        modes(steps=1), grid_fit(levels=20), fitted, IMPUTE,
        DAILY.format(expected("grp", "parf1")), GAPS, filled("daily"),
        rounded("annual", yearly, '"year", site_id, n_days', 0),
    )
    o["i6_effort_annual_draws"] = sql(
        modes(), IMPUTE, gdraws, GAPS, filled("ddraws", "draw, "),
        'SELECT "year", site_id, round(avg(effort), 6) AS mean, round(stddev_samp(effort), 6) AS '
        "sd, round(quantile_cont(effort, 0.025), 6) AS low, "
        'round(quantile_cont(effort, 0.975), 6) AS high FROM annual GROUP BY "year", site_id',
    )
    err = (
        "count(*) AS n_rows, round(avg((effort - ground_count) ** 2), 6) AS mse, "
        "round(avg(effort - ground_count), 6) + 0.0 AS bias"
    )
    o["i7_holdout_error"] = sql(
        VALID, modes("t", "train"),
        f"SELECT is_zero, {err} FROM {expected('vrows', 'part1')} GROUP BY is_zero",
    )
    o["i7_holdout_error_by_draw"] = sql(
        VALID, modes("t", "train"), counts("vrows", "part1", row_keys, N_DRAWS),
        f"SELECT draw, is_zero, {err} FROM drawn GROUP BY draw, is_zero",
    )

    # Every fold fitted on its own, from the pairs of the others.
    fold = f"least(floor({uniform(digest('obs_seq', 'cam_location'), 0)} * {N_FOLDS}), {N_FOLDS - 1})"
    parts, errors = [], []
    for k in range(N_FOLDS):
        known = "cam_count IS NOT NULL AND ground_count IS NOT NULL"
        parts += [
            f"train{k} AS (SELECT * FROM matched WHERE {fold} <> {k})",
            f"""vrows{k} AS (
  SELECT * EXCLUDE (location, cam_location), cam_location AS location, cam_count = 0 AS is_zero,
         1 AS n_rows, cam_count AS cam_sum,
         count(*) OVER (PARTITION BY "year", site_id, julian_day, "hour", cam_count = 0) AS n_cam
  FROM matched WHERE {fold} = {k} AND {known})""",
            modes(f"f{k}_", f"train{k}"),
        ]
        errors.append(
            f"SELECT {k} AS fold, is_zero, {err} FROM {expected(f'vrows{k}', f'parf{k}_1')} GROUP BY is_zero"
        )
    o["i7_cross_validation"] = sql(*parts, " UNION ALL ".join(errors))

    # gap filling
    o["g1_season_attributes"] = sql(GAPS, "SELECT * FROM attrs")
    o["g2_donors"] = sql(
        GAPS,
        'SELECT *, (count(*) OVER (PARTITION BY "year", site_id))::INTEGER AS n_similar FROM donor',
    )
    o["g3_donor_usable"] = sql(GAPS, "SELECT * FROM usable")
    o["g4_fill_days"] = sql(GAPS, "SELECT * FROM fill")
    o["g4_fill_day_counts_all_donors"] = sql(
        GAPS,
        'SELECT "year", site_id, count(*) AS n_fill FROM fill WHERE ("year", site_id) IN '
        '(SELECT ("year", site_id) FROM usable WHERE usable GROUP BY "year", site_id '
        'HAVING count(*) = 2) GROUP BY "year", site_id',
    )
    ranks = "string_agg(donor_rank::VARCHAR, ',' ORDER BY donor_rank) AS donor_ranks"
    o["g5_donors_per_fill_day"] = sql(
        GAPS, f"SELECT {day}, {ranks}, count(*)::INTEGER AS n_donors FROM supply GROUP BY {day}"
    )
    o["g6_fill_effort"] = sql(
        modes(), IMPUTE, daily, GAPS, filled("daily"), rounded("filled", ["effort"], day)
    )
    o["g7_seasons_to_fill"] = sql(
        GAPS,
        f'SELECT "year", site_id, {ranks}, count(*)::INTEGER AS n_donors FROM usable '
        'WHERE usable GROUP BY "year", site_id',
    )

    o["i6_effort_annual_posterior"] = sql(
        modes(steps=1), grid_fit(levels=20), hyper_grid(), mixed_draws(), IMPUTE,
        counts("grp", "mixed", GRP_KEYS, None), GAPS, filled("ddraws", "draw, "),
        'SELECT "year", site_id, round(avg(effort), 4) AS mean, round(stddev_samp(effort), 4) AS '
        "sd, round(quantile_cont(effort, 0.025), 4) AS low, "
        'round(quantile_cont(effort, 0.975), 4) AS high FROM annual GROUP BY "year", site_id',
    )
    o["j8_compare_fits_hyper"] = sql(
        modes(steps=1), grid_fit(), grid_fit(more=quadrature(NODES), s="q"),
        " UNION ALL ".join(
            f"SELECT variant || '.{name}' AS param, round(a.{x}, {d}) + 0.0 AS \"first\", round(b.{x}, {d}) + 0.0 AS "
            f"\"second\", round(a.{x} - b.{x}, {d}) + 0.0 AS difference FROM best a JOIN bestq b USING (variant)"
            for name, x, d in (("m", "m", 3), ("log_p", "lp", 2))
        ),
    )
    at = ", ".join(f"({p}::DOUBLE, {NormalDist().inv_cdf(p)!r}::DOUBLE)" for p in (0.025, 0.25, 0.5, 0.75, 0.975))
    o["m5_sensor_quantiles"] = sql(
        modes(), exact_cdf(),
        f"SELECT c.variant, c.site_id, c.location, u AS p, round({EXACT}, 4) + 0.0 AS exact, "
        "round(theta + sqrt(theta_var) * z, 4) + 0.0 AS normal FROM "
        f"(SELECT variant, site_id, location, theta, theta_var, u, z FROM modes, (VALUES {at}) q(u, z)) d "
        "ASOF JOIN cdf c ON c.variant = d.variant AND c.site_id = d.site_id AND c.location = d.location AND d.u >= c.up_to",
    )
    one = " UNION ALL ".join(
        f"SELECT '{e}' AS variant, site_id, location, t.draw::INTEGER AS draw, "
        f"{uniform(digest(repr(e), 'site_id', 'location', 't.draw'), 0)} AS u FROM par1, range(1, {N_DRAWS + 1}) t(draw)"
        for e in ("d", "L", "a")
    )
    o["m5_draw_parameters_exact"] = sql(
        modes(), exact_cdf(),
        "SELECT draw, site_id, location, "
        + ", ".join(f"max(round(v, 3) + 0.0) FILTER (variant = '{e}') AS {e}" for e in ("d", "L", "a"))
        + f" FROM (SELECT c.variant, c.site_id, c.location, draw, {EXACT} AS v FROM ({one}) d ASOF JOIN cdf c "
        "ON c.variant = d.variant AND c.site_id = d.site_id AND c.location = d.location AND d.u >= c.up_to) "
        "GROUP BY draw, site_id, location",
    )

    # posterior summaries
    o["q1_posterior_means"] = sql(
        modes(),
        " UNION ALL ".join(
            f"SELECT '{c}' AS param, round(avg({c}), 6) + 0.0 AS mean FROM {PAIR_DRAWS}" for c in six
        ),
    )
    sensor = "param, site_id, location"
    quant = ", ".join(
        f"round(quantile_cont(value, {p}), 6) + 0.0 AS {n}"
        for p, n in ((0.025, "q025"), (0.25, "q25"), (0.5, "q50"), (0.75, "q75"), (0.975, "q975"))
    )
    o["q2_posterior_summary"] = sql(
        modes(),
        f"long3 AS MATERIALIZED {LONG3}",
        f"SELECT * FROM (SELECT {sensor}, round(avg(value), 6) + 0.0 AS mean, "
        f"round(stddev_samp(value), 6) AS sd, {quant} FROM long3 GROUP BY {sensor}) JOIN "
        f"(SELECT {sensor}, round(sqrt((avg(n) - 1) / avg(n) + var_samp(cm) / avg(cv)), 6) AS r_hat "
        f"FROM (SELECT {sensor}, chain, avg(value) AS cm, var_samp(value) AS cv, count(*) AS n "
        f"FROM long3 GROUP BY {sensor}, chain) GROUP BY {sensor}) USING ({sensor})",
    )
    whole = (
        "(SELECT chain, draw, site_id, location, unnest(['d', 'L', 'a']) AS param, "
        f"unnest([d, L, a]) AS value FROM {PAIR_DRAWS})"
    )
    o["q2_posterior_summary_all_draws"] = o["q2_posterior_summary"].replace(LONG3, whole)
    natural = [
        ("1 / (1 + exp(-d))", "p_false_zero"), ("exp(L)", "false_zero_mean_weekday"),
        ("exp(L + L_cov)", "false_zero_mean_weekend"), ("exp(a)", "multiplier_weekday"),
        ("exp(a + a_cov)", "multiplier_weekend"),
    ]
    o["q3_back_transform"] = sql(
        modes(),
        f"SELECT {who}, " + ", ".join(f"round({x}, 6) AS {n}" for x, n in natural)
        + f" FROM {PAIR_DRAWS}",
    )
    o["q4_density_grid"] = sql(
        modes(),
        density(
            "SELECT 'multiplier_weekday' AS param, site_id, location, draw, exp(a) AS value "
            f"FROM {PAIR_DRAWS}", sensor, 5.0,
        ),
        rounded("dens", ["x", "density"], sensor + ", i", 4),
    )
    # Each quantity as a share of the end of its grid, which scales the density back.
    ends = (1.0, 10.0, 10.0, 5.0, 5.0)
    shares = ", ".join(f"({x}) / {end!r}::DOUBLE" for (x, _), end in zip(natural, ends))
    o["q4_density_grid_quantities"] = sql(
        modes(),
        density(
            f"SELECT site_id, location, draw, unnest({[n for _, n in natural]}) AS param, "
            f"unnest([{', '.join(f'{end!r}::DOUBLE' for end in ends)}]) AS top, "
            f"unnest([{shares}]) AS value FROM {PAIR_DRAWS}", sensor + ", top", 1.0,
        ),
        rounded("(SELECT * REPLACE (x * top AS x, density / top AS density) FROM dens)", ["x", "density"], sensor + ", i", 4),
    )
    values = ", ".join(x for x, _ in natural)
    o["q4_binned_density"] = sql(
        modes(),
        density(
            f"SELECT site_id, location, draw, unnest({[n for _, n in natural]}) AS param, "
            f"unnest([{', '.join(f'{end!r}::DOUBLE' for end in ends)}]) AS top, "
            f"unnest([{values}]) AS value FROM {PAIR_DRAWS}", sensor + ", top", 1.0,
        ).split("dens AS (")[0].rstrip().rstrip(","),
        f"""
cut AS (
  SELECT {sensor}, w, top / 511 AS step, greatest(ceil(16 * (top / 511) / w), 1) AS parts,
         value / (top / 511 / greatest(ceil(16 * (top / 511) / w), 1)) AS place
  FROM src JOIN width USING ({sensor}, top))""",
        f"""
cells AS (
  SELECT {sensor}, w, step, parts, cell, sum(weight) AS weight FROM (
    SELECT {sensor}, w, step, parts, unnest([floor(place), floor(place) + 1]) AS cell,
           unnest([floor(place) + 1 - place, place - floor(place)]) AS weight FROM cut)
  GROUP BY ALL)""",
        f"""
points AS (
  SELECT {sensor}, i::INTEGER AS i, i * step AS x,
         sum(weight * exp(-0.5 * ((i * step - cell * (step / parts)) / w) ** 2)) / ({N_DRAWS} * w * sqrt(2 * pi())) AS density
  FROM cells, range(0, 512) t(i) GROUP BY {sensor}, i, step, w)""",
        rounded("points", ["x", "density"], sensor + ", i", 4),
    )
    quantities = []
    for param, variant, effect, end in (
        ("p_false_zero", "d", "theta", 1.0), ("false_zero_mean_weekday", "L_wk", "theta", 10.0),
        ("false_zero_mean_weekend", "L_wk", "both", 10.0), ("multiplier_weekday", "a_wk", "theta", 5.0),
        ("multiplier_weekend", "a_wk", "both", 5.0),
    ):
        inside = "x > 0 AND x < 1" if end == 1.0 else "x > 0"
        back, slope = ("ln(x / (1 - x))", "x * (1 - x)") if end == 1.0 else ("ln(x)", "x")
        quantities.append(
            f"SELECT '{param}' AS param, i, x, CASE WHEN {inside} THEN exp(-0.5 * (({back} - {effect}_mean) / {effect}_sd) ** 2) "
            f"/ ({effect}_sd * sqrt(2 * pi())) / ({slope}) ELSE 0.0 END AS density "
            f"FROM {new_effects}, (SELECT t.i::INTEGER AS i, t.i * ({end}::DOUBLE / 511) AS x FROM range(512) t(i)) "
            f"WHERE variant = '{variant}'"
        )
    o["q4_density_grid_new_sensor"] = sql(
        modes(), rounded("(" + " UNION ALL ".join(quantities) + ")", ["x", "density"], "param, i", 4)
    )
    # By day sets, the same results.
    for name in (
        "a2_days_total", "a3_season_coverage", "g3_donor_usable", "g4_fill_days", "u2_common_days",
        "u3_uncommon_days", "u4_active_days", "u4_active_day_counts",
    ):
        o[f"{name}_by_sets"] = o[name]
    return o


ORACLE = _oracles()
