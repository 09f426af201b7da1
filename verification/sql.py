"""DuckDB side of the checks: common table expressions over the given tables."""

from __future__ import annotations

from .fixtures import N_BINS, TOKENS_CTE, WS

UNBOUNDED = 1e-7 / 2.220446049250313e-16
SERIES = "ran, parent, child, treatment"


def r(x: str, d: int = 6) -> str:
    return f"(round({x}, {d}) + 0.0)"


def expm1(x: str) -> str:
    return f"(CASE WHEN abs({x}) < 1e-5 THEN ({x}) + ({x}) * ({x}) / 2 + ({x}) * ({x}) * ({x}) / 6 ELSE exp({x}) - 1 END)"


def warp(v: str, b, w: str) -> str:
    up = f"{v} - {expm1(f'(-({w}) * ({w}) * ({v}) / {b})')} * ({b} - ({v}))"
    down = f"{v} + {expm1(f'(-({w}) * ({w}) * ({b} - ({v})) / {b})')} * ({v})"
    return f"(CASE WHEN {w} > 0 THEN {up} ELSE {down} END)"


def logistic(x: str) -> str:
    return f"(CASE WHEN {x} > 0 THEN 1 / (1 + exp(-({x}))) ELSE exp({x}) / (1 + exp({x})) END)"


def hash32(*parts: str, word: str = "0") -> str:
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"('0x' || substr(md5({text}), CAST(({word}) * 8 + 1 AS INT), 8))::BIGINT"


def gamma_poisson_log(y: str, m: str, v: str) -> str:
    s, q = f"(({m}) * ({m}) / ({v}))", f"(({m}) / ({v}))"
    return (f"({s} * ln({q}) + lgamma(({y}) + {s}) - lgamma(({y}) + 1) - lgamma({s}) "
            f"- (({y}) + {s}) * ln(1 + {q}))")


def poly(x: str, coefficients: list[float]) -> str:
    out = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        out = f"({out} * ({x}) + {c!r})"
    return out


def normal_quantile(p: str) -> str:
    from countweave.functions import special as s

    q = f"(({p}) - 0.5)"
    near = f"(0.180625 - {q} * {q})"
    rr = f"sqrt(-ln(CASE WHEN {q} < 0 THEN ({p}) ELSE 1 - ({p}) END))"
    centre = f"{q} * {poly(near, s.PPND_A)} / {poly(near, s.PPND_B)}"
    mid, far = f"({rr} - 1.6)", f"({rr} - 5.0)"
    tail = (f"(CASE WHEN {rr} <= 5 THEN {poly(mid, s.PPND_C)} / {poly(mid, s.PPND_D)} "
            f"ELSE {poly(far, s.PPND_E)} / {poly(far, s.PPND_F)} END)")
    return f"(CASE WHEN abs({q}) <= 0.425 THEN {centre} WHEN {q} < 0 THEN -{tail} ELSE {tail} END)"


def normal_cdf(x: str) -> str:
    from countweave.functions import special as s

    a = f"abs({x})"
    near = f"exp(-({a}) * ({a}) / 2) * {poly(a, s.TAIL_P[::-1])} / {poly(a, s.TAIL_Q[::-1])}"
    frac = f"({a} + 0.65)"
    for k in (4, 3, 2, 1):
        frac = f"({a} + {float(k)} / {frac})"
    far = f"exp(-({a}) * ({a}) / 2) / {frac} / sqrt(2 * pi())"
    tail = f"(CASE WHEN {a} < 7.07106781186547 THEN {near} ELSE {far} END)"
    return f"(CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END)"


CELL = "ran, parent, child, disc, tax, bin"

TREATMENTS = """
dl AS (SELECT disc, row_number() OVER (ORDER BY disc) - 1 AS di FROM (SELECT DISTINCT disc FROM tokens)),
tl AS (SELECT tax, row_number() OVER (ORDER BY tax) - 1 AS ti FROM (SELECT DISTINCT tax FROM tokens)),
treatments AS (SELECT CAST(row_number() OVER (ORDER BY (di > 0)::INT + (ti > 0)::INT, (di = 0)::INT, di, ti) - 1 AS INT) AS treatment_idx,
  CASE WHEN di = 0 AND ti = 0 THEN 'ref' ELSE CASE WHEN di > 0 THEN disc ELSE '' END || CASE WHEN ti > 0 THEN tax ELSE '' END END AS treatment,
  disc, tax, di, ti, (di > 0)::INT + (ti > 0)::INT AS size FROM dl, tl),
pairs AS (SELECT a.treatment, b.treatment AS effect, CASE WHEN (a.size - b.size) % 2 = 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign
  FROM treatments a, treatments b WHERE (b.di = 0 OR b.di = a.di) AND (b.ti = 0 OR b.ti = a.ti))"""

SUMS = f"sums AS (SELECT {CELL}, sum(count) AS total, count(count) AS n_tokens FROM tokens GROUP BY ALL)"

GRID = f"""
series_keys AS (SELECT ran, parent, child, treatment, disc, tax FROM
  (SELECT DISTINCT ran FROM tokens UNION ALL SELECT 'none') a, (SELECT DISTINCT parent FROM tokens) b,
  (SELECT DISTINCT child FROM tokens) c, treatments),
grid AS (SELECT s.*, CAST(b.bin AS INT) AS bin FROM series_keys s, range(1, {N_BINS} + 1) b(bin))"""

FILL = """none_fill AS (SELECT parent, child, disc, tax, bin, round(round(exp(avg(ln(1 + total))) - 1, 9)) AS fill_log,
  round(round(avg(total), 9)) AS fill_mean, count(*) AS pool_size FROM sums WHERE n_tokens > 0 GROUP BY ALL)"""


def cells_cte(fill: str = "fill_log") -> str:
    return f"""
cells0 AS (SELECT g.*, s.n_tokens, CASE WHEN g.ran = 'none' THEN f.{fill} ELSE s.total END AS count,
    s.n_tokens IS NOT NULL OR g.ran = 'none' AS observed
  FROM grid g LEFT JOIN (SELECT * FROM sums WHERE n_tokens > 0) s USING ({CELL})
  LEFT JOIN none_fill f ON g.ran = 'none' AND f.parent = g.parent AND f.child = g.child AND f.disc = g.disc
    AND f.tax = g.tax AND f.bin = g.bin),
cells AS (SELECT *, ln(1 + count) AS count_log FROM cells0)"""


def base(tokens: str = TOKENS_CTE, fill: str = "fill_log") -> list[str]:
    return [tokens, TREATMENTS, SUMS, GRID, FILL, cells_cte(fill)]


def _ratio() -> str:
    half = {w: w // 2 for w in (WS, 2 * WS, 4 * WS)}
    parts, scores, filled = [], [], []
    for name, w in (("r1", WS), ("r2", 2 * WS), ("r4", 4 * WS)):
        h = half[w]
        parts += [
            f"count(*) OVER (s ROWS BETWEEN {h} PRECEDING AND {w - h - 1} FOLLOWING) AS {name}_n",
            f"var_pop(count_log) OVER (s ROWS BETWEEN {h} PRECEDING AND {w - h - 1} FOLLOWING) AS {name}_v",
            f"var_pop(count_log) OVER (s ROWS BETWEEN {h} PRECEDING AND 1 PRECEDING) AS {name}_a",
            f"var_pop(count_log) OVER (s ROWS BETWEEN CURRENT ROW AND {w - h - 1} FOLLOWING) AS {name}_b",
        ]
        fit = lambda n, v: f"-{n} / 2.0 * (ln(2 * pi() * {v}) + 1)"
        scores += [
            f"CASE WHEN {name}_n = {w} THEN CASE WHEN {name}_v <= 1e-24 THEN 1.0 ELSE {fit(w, name + '_v')} END END AS {name}_null",
            f"CASE WHEN {name}_n = {w} THEN CASE WHEN {name}_a <= 1e-24 OR {name}_b <= 1e-24 THEN 1.0 ELSE "
            f"{fit(h, name + '_a')} + {fit(w - h, name + '_b')} END END AS {name}_split",
        ]
        for side in ("null", "split"):
            c = f"{name}_{side}"
            filled.append(f"coalesce({c}, coalesce(sum({c}) OVER g, 0) / count(*) OVER g) AS {c}")
    return f"""
complete AS (SELECT * FROM (SELECT *, count(*) FILTER (observed AND count IS NOT NULL) OVER (PARTITION BY {SERIES}) AS nn FROM cells)
  WHERE nn = {N_BINS}),
frames AS (SELECT {SERIES}, bin, count_log, {', '.join(parts)} FROM complete WINDOW s AS (PARTITION BY {SERIES} ORDER BY bin)),
scores AS (SELECT {SERIES}, bin, {', '.join(scores)} FROM frames),
filled AS (SELECT {SERIES}, bin, r1_null AS r1_null_raw, r1_split AS r1_split_raw, {', '.join(filled)} FROM scores WINDOW g AS (PARTITION BY {SERIES})),
ratio AS (SELECT {SERIES}, bin, r1_null_raw, r1_split_raw, r1_null, r1_split, r1_split - r1_null AS r1, r2_split - r2_null AS r2, r4_split - r4_null AS r4 FROM filled),
curves AS (SELECT parent, child, bin, avg(r1) AS r1, avg(r2) AS r2, avg(r4) AS r4 FROM ratio GROUP BY ALL)"""


RATIO = _ratio()


def tops(cutoff: float = 2.0) -> str:
    cols = ", ".join(
        f"avg({c}) OVER g + {cutoff} * stddev_pop({c}) OVER g AS {c}_max" for c in ("r1", "r2", "r4"))
    return f"tops AS (SELECT *, {cols}, count(*) OVER g AS len FROM curves WINDOW g AS (PARTITION BY parent, child))"


def peaks(name: str, columns: list[str], ws: int = WS) -> str:
    h = ws // 2
    union = " UNION ALL ".join(
        f"SELECT parent, child, bin - 1 AS i, {s} AS s, {c} AS v, {c}_max AS top, len FROM tops" for s, c in enumerate(columns))
    return f"""
{name}_c AS (SELECT *, row_number() OVER (PARTITION BY parent, child ORDER BY i, s) AS rn FROM ({union})
  WHERE v > top AND i > {h} AND i < len - {h}),
{name}_r AS (SELECT parent, child, rn, [i] AS found, i AS last_i, v AS last_v, i AS fired FROM {name}_c WHERE rn = 1
  UNION ALL SELECT c.parent, c.child, c.rn,
    CASE WHEN c.i <> q.fired AND c.i - q.last_i > {h} THEN list_append(q.found, c.i)
         WHEN c.i <> q.fired AND c.v > q.last_v THEN list_append(q.found[1:len(q.found) - 1], c.i) ELSE q.found END,
    CASE WHEN c.i <> q.fired AND (c.i - q.last_i > {h} OR c.v > q.last_v) THEN c.i ELSE q.last_i END,
    CASE WHEN c.i <> q.fired AND (c.i - q.last_i > {h} OR c.v > q.last_v) THEN c.v ELSE q.last_v END,
    CASE WHEN c.i <> q.fired AND (c.i - q.last_i > {h} OR c.v > q.last_v) THEN c.i ELSE q.fired END
  FROM {name}_r q JOIN {name}_c c ON c.parent = q.parent AND c.child = q.child AND c.rn = q.rn + 1),
{name} AS (SELECT parent, child, CAST(generate_subscripts(f, 1) - 1 AS INT) AS k, CAST(unnest(f) + 1 AS INT) AS point
  FROM (SELECT parent, child, arg_max(found, rn) AS f FROM {name}_r GROUP BY ALL))"""


# the alignment cell by cell: costs row by row (three rows kept), then back along the moves
ALIGNED = f"""
pairs_of AS (SELECT dense_rank() OVER (ORDER BY {SERIES}) AS sid, {SERIES}, bin - 1 AS at, coalesce(ratio.r2, 1.0) AS x, curves.r2 AS y
  FROM ratio JOIN curves USING (parent, child, bin) WHERE (parent, child) IN (SELECT (parent, child) FROM pk)),
gaps AS (SELECT a.sid, a.at AS i, b.at AS j, abs(a.x - b.y) AS d FROM pairs_of a JOIN pairs_of b ON a.sid = b.sid),
near AS (SELECT *, lag(d, 1) OVER row_ AS l1, lag(d, 2) OVER row_ AS l2, lag(d, 1) OVER col_ AS u1, lag(d, 2) OVER col_ AS u2
  FROM gaps WINDOW row_ AS (PARTITION BY sid, i ORDER BY j), col_ AS (PARTITION BY sid, j ORDER BY i)),
costs AS (SELECT sid, i, j, CASE WHEN j = 0 THEN d END AS c1, NULL::DOUBLE AS c2, NULL::DOUBLE AS c3, NULL::INT AS move FROM near WHERE i = 0
  UNION ALL SELECT sid, i, j, least(o0, o1, o2, o3, o4), c1, c2,
    CASE least(o0, o1, o2, o3, o4) WHEN o0 THEN 0 WHEN o1 THEN 1 WHEN o2 THEN 2 WHEN o3 THEN 3 WHEN o4 THEN 4 END
  FROM (SELECT n.sid, n.i, n.j, c.c1, c.c2, lag(c1, 3) OVER w + 2 * l2 + l1 + d AS o0, lag(c1, 2) OVER w + 2 * l1 + d AS o1,
      lag(c1, 1) OVER w + 2 * d AS o2, lag(c2, 1) OVER w + 2 * u1 + d AS o3, lag(c3, 1) OVER w + 2 * u2 + u1 + d AS o4
    FROM costs c JOIN near n ON n.sid = c.sid AND n.i = c.i + 1 AND n.j = c.j WINDOW w AS (PARTITION BY c.sid ORDER BY c.j))),
trail AS (SELECT DISTINCT sid, {N_BINS - 1} AS i, {N_BINS - 1} AS j FROM pairs_of
  UNION ALL SELECT t.sid, CAST(t.i - [1, 1, 1, 2, 3][c.move + 1] AS INT), CAST(t.j - [3, 2, 1, 1, 1][c.move + 1] AS INT)
  FROM trail t JOIN costs c ON c.sid = t.sid AND c.i = t.i AND c.j = t.j WHERE c.move IS NOT NULL),
visited AS (SELECT t.sid, t.i - least(s, [1, 1, 1, 2, 3][c.move + 1] - 1) AS i, t.j - least(s, [3, 2, 1, 1, 1][c.move + 1] - 1) AS j
  FROM trail t JOIN costs c USING (sid, i, j), unnest([0, 1, 2]) u(s) WHERE s < [3, 2, 1, 2, 3][c.move + 1]
  UNION ALL SELECT DISTINCT sid, 0, 0 FROM pairs_of),
points AS (SELECT {SERIES}, pk.k, CAST(least(greatest(round_even(avg(v.i) + 1, 0) - 1, {WS}), {N_BINS - WS}) AS INT) AS bin0
  FROM (SELECT DISTINCT sid, {SERIES} FROM pairs_of) JOIN pk USING (parent, child) JOIN visited v USING (sid) WHERE v.j = pk.point - 1 GROUP BY ALL)"""
TREATMENT_POINTS = """tpoints AS (SELECT parent, child, treatment, k, avg(bin0) AS point, CAST(round(avg(bin0)) AS INT) AS bin0 FROM points GROUP BY ALL)"""

# change points for the steps after them: the best bin of each half of every complete series
POINTS = f"""
points AS (SELECT {SERIES}, 0 AS k, arg_max(bin, r1) - 1 AS bin0 FROM ratio WHERE bin BETWEEN {WS // 2 + 2} AND {N_BINS // 2} GROUP BY ALL
  UNION ALL SELECT {SERIES}, 1 AS k, arg_max(bin, r1) - 1 AS bin0 FROM ratio WHERE bin BETWEEN {N_BINS // 2 + 1} AND {N_BINS - WS // 2} GROUP BY ALL),
tpoints AS (SELECT parent, child, treatment, k, avg(bin0) AS point, CAST(round(avg(bin0)) AS INT) AS bin0 FROM points GROUP BY ALL)"""

LOG_MEANS = "log_means AS (SELECT parent, child, treatment, bin, avg(count_log) FILTER (observed) AS mean_log FROM cells GROUP BY ALL)"
DISPERSION = """dispersion AS (SELECT parent, child, m AS mean, v AS var, CASE WHEN v > m THEN (v / m - 1) / m ELSE 0 END AS dispersion
  FROM (SELECT parent, child, avg(count) FILTER (observed) AS m, var_pop(count) FILTER (observed) AS v FROM cells GROUP BY ALL))"""

VALUES = f"""
wide AS (SELECT parent, child, treatment, max(point) FILTER (k = 0) AS p0, max(point) FILTER (k = 1) AS p1,
  max(bin0) FILTER (k = 0) AS b0, max(bin0) FILTER (k = 1) AS b1 FROM tpoints GROUP BY ALL),
blocks AS (SELECT parent, child, treatment, unnest([0, 1, 2]) AS k, unnest([0, b0 - 1, b1 - 1]) AS start,
  unnest([b0, b1, {N_BINS - 1}]) AS stop FROM wide),
rates AS (SELECT b.parent, b.child, b.treatment, b.k, avg(m.mean_log) AS value FROM blocks b JOIN log_means m
  ON m.parent = b.parent AND m.child = b.child AND m.treatment = b.treatment AND m.bin - 1 >= b.start AND m.bin - 1 < b.stop GROUP BY ALL),
vals AS (SELECT parent, child, treatment, 'Rt' AS component, k, value FROM rates
  UNION ALL SELECT parent, child, treatment, 'tpoint', k, point FROM tpoints
  UNION ALL SELECT parent, child, treatment, 'tslope', k, greatest(4.0 / (3 * (k + 1)), 0.25) FROM tpoints),
effects AS (SELECT y.parent, y.child, y.component, y.k, p.treatment, sum(p.sign * y.value) AS value
  FROM vals y JOIN pairs p ON y.treatment = p.effect GROUP BY ALL)"""

RUNS = """
prof AS (SELECT parent, child, treatment, list(mean_log ORDER BY bin) AS xs FROM log_means GROUP BY ALL),
tr AS (SELECT c.parent, c.child, c.treatment, c.k, xs, c.start AS st, p.stop - p.start AS szp, c.stop - c.start AS szc, (rc.value - rp.value) * 0.8 AS need,
    CASE WHEN rc.value < rp.value THEN -1 ELSE 1 END AS sgn
  FROM blocks c JOIN blocks p ON p.parent = c.parent AND p.child = c.child AND p.treatment = c.treatment AND p.k = c.k - 1
  JOIN rates rc ON rc.parent = c.parent AND rc.child = c.child AND rc.treatment = c.treatment AND rc.k = c.k
  JOIN rates rp ON rp.parent = c.parent AND rp.child = c.child AND rp.treatment = c.treatment AND rp.k = c.k - 1
  JOIN prof f ON f.parent = c.parent AND f.child = c.child AND f.treatment = c.treatment),
steps AS (SELECT parent, child, treatment, k, 0 AS turn, 0 AS bb, 0 AS bf, 0.0::DOUBLE AS found FROM tr
  UNION ALL SELECT s.parent, s.child, s.treatment, s.k, turn + 1, CASE WHEN turn % 2 = 1 AND bb < szp THEN bb + 1 ELSE bb END,
    CASE WHEN turn % 2 = 0 AND bf < szc THEN bf + 1 ELSE bf END,
    CASE WHEN bf = 0 THEN xs[st + 1] ELSE list_avg(xs[st + 1:st + bf]) END - CASE WHEN bb = 0 THEN xs[st + 1] ELSE list_avg(xs[greatest(st - bb, 0) + 1:st]) END
  FROM steps s JOIN tr ON tr.parent = s.parent AND tr.child = s.child AND tr.treatment = s.treatment AND tr.k = s.k
  WHERE found * sgn < need * sgn AND (bb < szp OR bf < szc))"""

# blocks between any number of change points, slopes from the runs
ANY_BLOCKS = f"""
blocks AS (SELECT parent, child, treatment, k, CASE WHEN k = 0 THEN 0 ELSE ps[k] - 1 END AS start,
    CASE WHEN k = len(ps) THEN {N_BINS - 1} ELSE ps[k + 1] END AS stop
  FROM (SELECT parent, child, treatment, coalesce(ps, []) AS ps, unnest(range(coalesce(len(ps), 0) + 1)) AS k
    FROM (SELECT DISTINCT parent, child, treatment FROM log_means)
    LEFT JOIN (SELECT parent, child, treatment, list(bin0 ORDER BY k) AS ps FROM tpoints GROUP BY ALL) USING (parent, child, treatment))),
rates AS (SELECT b.parent, b.child, b.treatment, b.k, avg(m.mean_log) AS value FROM blocks b JOIN log_means m
  ON m.parent = b.parent AND m.child = b.child AND m.treatment = b.treatment AND m.bin - 1 >= b.start AND m.bin - 1 < b.stop GROUP BY ALL)"""
FOUND_VALUES = """
vals AS (SELECT parent, child, treatment, 'Rt' AS component, k, value FROM rates
  UNION ALL SELECT parent, child, treatment, 'tpoint', k, point FROM tpoints
  UNION ALL SELECT parent, child, treatment, 'tslope', k - 1, greatest(4.0 / greatest(arg_max(bb + bf, turn), 1), 0.25) FROM steps GROUP BY parent, child, treatment, k),
effects AS (SELECT y.parent, y.child, y.component, y.k, p.treatment, sum(p.sign * y.value) AS value
  FROM vals y JOIN pairs p ON y.treatment = p.effect GROUP BY ALL)"""

WARPS = f"""
warps AS (SELECT ran, child, component, -0.1 + 0.2 * ({hash32('42', 'ran', 'child', 'component')} / 4294967296.0) AS value
  FROM (SELECT DISTINCT ran FROM tokens), (SELECT DISTINCT child FROM tokens), (SELECT unnest(['point', 'rate', 'slope']) AS component))"""


def predicted(draws: bool = False) -> str:
    """Warped components per series and predictions per cell; optionally for scaled draws."""
    d = "draw_id, " if draws else ""
    f = "(1 + 0.01 * draw_id)" if draws else "1"
    source = ", (SELECT unnest([0, 1, 2]) AS draw_id) dr" if draws else ""
    pick = lambda c, k: f"max(value) FILTER (component = '{c}' AND k = {k}) AS {c}{k}"
    u = UNBOUNDED
    return f"""
vwide AS (SELECT parent, child, treatment, {', '.join(pick('Rt', k) for k in range(3))}, {', '.join(pick('tslope', k) for k in range(2))},
  {', '.join(pick('tpoint', k) for k in range(2))} FROM vals GROUP BY ALL),
wwide AS (SELECT ran, child, max(value) FILTER (component = 'rate') AS wr, max(value) FILTER (component = 'slope') AS ws,
  max(value) FILTER (component = 'point') AS wp FROM warps GROUP BY ALL),
unwarped AS (SELECT {d}s.{SERIES.replace(', ', ', s.')}, {', '.join(f'v.{c} * {f} AS {c}' for c in ('Rt0', 'Rt1', 'Rt2', 'tslope0', 'tslope1', 'tpoint0', 'tpoint1'))},
  coalesce(w.wr, 0) * {f} AS wr, coalesce(w.ws, 0) * {f} AS ws, coalesce(w.wp, 0) * {f} AS wp
  FROM series_keys s JOIN vwide v USING (parent, child, treatment) LEFT JOIN wwide w ON w.ran = s.ran AND w.child = s.child{source}),
warped AS (SELECT {d}{SERIES}, {', '.join(f"{warp(f'Rt{k}', u, 'wr')} AS R{k}" for k in range(3))},
  {', '.join(f"{warp(f'tslope{k}', u, 'ws')} AS S{k}" for k in range(2))},
  {', '.join(f"{warp(f'tpoint{k}', float(N_BINS), 'wp')} AS P{k}" for k in range(2))} FROM unwarped),
pred0 AS (SELECT {d}c.*, R0 + (R1 - R0) * {logistic('(S0 * (c.bin - P0))')} + (R2 - R1) * {logistic('(S1 * (c.bin - P1))')} AS pred_log
  FROM cells c JOIN warped w USING ({SERIES})),
pred AS (SELECT *, exp(pred_log) - 1 AS pred FROM pred0),
terms AS (SELECT {d}p.child, p.parent, {gamma_poisson_log('count_log', 'pred_log', '((exp(pred_log) - 1 + dispersion * (exp(pred_log) - 1) * (exp(pred_log) - 1)) / (exp(pred_log) * exp(pred_log)))')} AS ll,
  pred_log < 0 OR pred_log IS NULL AS bad FROM pred p JOIN dispersion USING (parent, child) WHERE observed AND count IS NOT NULL),
nll AS (SELECT {d}child, CASE WHEN bool_or(bad) THEN 1e100 ELSE -sum(ll) END AS neg_loglik, count(*) AS n_cells FROM terms GROUP BY ALL),
dist AS (SELECT {d}{SERIES}, unnest(['slope', 'slope', 'gap', 'gap', 'gap', 'rate', 'rate', 'rate']) AS what, unnest([0, 1, 0, 1, 2, 0, 1, 2]) AS k,
  unnest([S0, S1, P0 - 0 - 2.0, P1 - P0 - 2.0, {float(N_BINS)} - P1 - 2.0, R0, R1, R2]) AS distance FROM warped)"""


def model_ctes(draws: bool = False) -> list[str]:
    return [*base(), RATIO, POINTS, LOG_MEANS, DISPERSION, VALUES, WARPS, predicted(draws)]


COEF = f"""coef AS (SELECT {SERIES}, what, k, sqrt((SELECT count(*) FROM dist0) / ((SELECT sum(neg_loglik) FROM nll0) * 0.01)) / distance AS coefficient FROM dist0)"""


DRAWS = """
d0 AS (SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'chain' ELSE 'bootstrap' END AS source, CAST(l_suppkey % 12 AS BIGINT) AS param_idx,
  l_orderkey AS draw_id, avg((l_discount - 0.05) * 10 + (l_suppkey % 12) * 0.05) AS value FROM lineitem GROUP BY ALL),
draws AS (SELECT *, false AS is_full_fit FROM d0 UNION ALL SELECT source, param_idx, CAST(-1 AS BIGINT), avg(value) * 1.1 + 0.0137, true FROM d0 GROUP BY ALL),
params AS (SELECT DISTINCT param_idx, CASE WHEN param_idx < 9 THEN 'beta' ELSE 'wfactor' END AS kind,
  CASE WHEN param_idx < 3 THEN 'Rt' WHEN param_idx < 6 THEN 'tslope' WHEN param_idx < 9 THEN 'tpoint' WHEN param_idx = 9 THEN 'point'
       WHEN param_idx = 10 THEN 'rate' ELSE 'slope' END AS component,
  CASE WHEN param_idx < 9 THEN 'p' END AS parent, concat('c', param_idx % 3) AS child, CASE WHEN param_idx >= 9 THEN 's0' END AS ran,
  CASE WHEN param_idx < 9 THEN 'd1' END AS treatment, CASE WHEN param_idx < 9 THEN CAST(param_idx % 3 AS INT) END AS k,
  concat('par_', param_idx) AS name FROM d0)"""
# every line: both sources as one
BOOT = """
b0 AS (SELECT CAST(l_suppkey % 12 AS BIGINT) AS param_idx, l_orderkey AS draw_id,
  avg((l_discount - 0.05) * 10 + (l_suppkey % 12) * 0.05) AS value FROM lineitem GROUP BY ALL),
boot AS (SELECT *, false AS is_full_fit FROM b0 UNION ALL SELECT param_idx, CAST(-1 AS BIGINT), avg(value) * 1.1 + 0.0137, true FROM b0 GROUP BY ALL)"""
DIAG = """diag AS (SELECT o_orderkey AS draw_id, CASE WHEN o_orderkey % 20 = 0 THEN 5 ELSE 3 END AS status, o_totalprice AS objective,
  o_totalprice * 0.9 AS neg_loglik, CAST(o_orderkey % 1000 AS INT) AS evals FROM orders)"""
DIAG_FULL = "diag_full AS (SELECT draw_id, status FROM diag UNION ALL SELECT -1, 3)"
P_VALUES = """
est AS (SELECT param_idx, value AS estimate FROM boot WHERE is_full_fit),
centre AS (SELECT param_idx, avg(value) AS m FROM boot GROUP BY ALL),
pv AS (SELECT b.param_idx, 1 - avg((b.value - c.m <= abs(e.estimate))::INT) + avg((b.value - c.m <= -abs(e.estimate))::INT) AS p_value
  FROM boot b JOIN centre c USING (param_idx) JOIN est e USING (param_idx) GROUP BY ALL),
beta_p AS (SELECT pv.* FROM pv JOIN params USING (param_idx) WHERE kind = 'beta'),
holm AS (SELECT *, p_value * (m - rk + 1) AS p_value_adj, 0.05 / (m - rk + 1) AS alpha_adj FROM
  (SELECT *, row_number() OVER (ORDER BY p_value, param_idx) AS rk, count(*) OVER () AS m FROM beta_p)),
bonf AS (SELECT *, p_value * (count(*) OVER ()) AS p_value_adj, 0.05 / (count(*) OVER ()) AS alpha_adj FROM beta_p)"""
MARK = ("CASE WHEN p_value_adj IS NULL THEN ' ' WHEN p_value_adj < 0.001 THEN '***' WHEN p_value_adj < 0.01 THEN '**' "
        "WHEN p_value_adj < 0.05 THEN '*' ELSE 'ns' END")


def quantile_at(level: str, side: str) -> str:
    """Interpolated quantile of boot draws at a per-parameter level, from sorted lists."""
    p = f"({level} / 2)" if side == "low" else f"(1 - {level} / 2)"
    at = f"((len(xs) - 1) * {p})"
    lo, hi = f"xs[CAST(floor({at}) AS BIGINT) + 1]", f"xs[CAST(ceil({at}) AS BIGINT) + 1]"
    return f"({lo} + ({at} - floor({at})) * ({hi} - {lo}))"


SORTED = "sorted AS (SELECT param_idx, list(value ORDER BY value) AS xs FROM boot GROUP BY ALL)"


def query(ctes: list[str], select: str) -> str:
    return f"WITH RECURSIVE {', '.join(ctes)} {select}"


def digamma(x: str) -> str:
    """The shifted Stirling series of the library; DuckDB has no such function."""
    from countweave.functions.special import STIRLING

    inv = f"(1 / (({x}) + 8))"
    series = f"{inv} * {inv} * {poly(f'{inv} * {inv}', [(2 * i + 1) * c for i, c in enumerate(STIRLING)])}"
    return f"(ln(({x}) + 8) - 0.5 * {inv} - {series} - ({' + '.join(f'1 / (({x}) + {k})' for k in range(8))}))"


def _warp_slopes() -> str:
    grown = "exp(CASE WHEN w > 0 THEN -w * w / b * v ELSE -w * w / b * (b - v) END)"
    return (f"{grown} + w * w / b * {grown} * CASE WHEN w > 0 THEN b - v ELSE v END AS dv, "
            f"2 * w / b * v * (b - v) * {grown} * CASE WHEN w > 0 THEN 1 ELSE -1 END AS dw")


def gradient() -> str:
    """Derivatives of the penalised objective by every parameter (slopes), after model_ctes and coef."""
    s = SERIES
    return f"""
vals7 AS (SELECT {s}, unnest(['Rt', 'Rt', 'Rt', 'tslope', 'tslope', 'tpoint', 'tpoint']) AS component, unnest([0, 1, 2, 0, 1, 0, 1]) AS k,
  unnest([Rt0, Rt1, Rt2, tslope0, tslope1, tpoint0, tpoint1]) AS v, unnest([wr, wr, wr, ws, ws, wp, wp]) AS w,
  unnest([{UNBOUNDED}, {UNBOUNDED}, {UNBOUNDED}, {UNBOUNDED}, {UNBOUNDED}, {float(N_BINS)}, {float(N_BINS)}]) AS b FROM unwarped),
bent AS (SELECT {s}, component, k, {_warp_slopes()} FROM vals7),
g0 AS (SELECT {s}, bin, count_log AS y, pred_log AS r, dispersion AS d, exp(pred_log) - 1 AS p FROM pred JOIN dispersion USING (parent, child)
  WHERE observed AND count IS NOT NULL),
g1 AS (SELECT {s}, bin, y, r, (p + d * p * p) / ((p + 1) * (p + 1)) AS v, (1 - p + 2 * d * p) / ((p + 1) * (p + 1)) AS dv FROM g0),
g2 AS (SELECT {s}, bin, y, r * r / v AS s, r / v AS q, 2 * r / v - r * r * dv / (v * v) AS ds, 1 / v - r * dv / (v * v) AS dq FROM g1),
g3 AS (SELECT {s}, bin, -((ln(q) + {digamma('y + s')} - {digamma('s')} - ln(1 + q)) * ds + (s / q - (y + s) / (q + 1)) * dq) AS slope FROM g2),
g4 AS (SELECT {s}, bin, slope, R0, R1, R2, S0, S1, P0, P1, {logistic('(S0 * (bin - P0))')} AS a0, {logistic('(S1 * (bin - P1))')} AS a1
  FROM g3 JOIN warped USING ({s})),
fitted AS (SELECT {s}, sum(slope * (1 - a0)) AS r0, sum(slope * (a0 - a1)) AS r1, sum(slope * a1) AS r2,
  sum(slope * (R1 - R0) * a0 * (1 - a0) * (bin - P0)) AS s0, sum(slope * (R2 - R1) * a1 * (1 - a1) * (bin - P1)) AS s1,
  -sum(slope * (R1 - R0) * a0 * (1 - a0) * S0) AS p0, -sum(slope * (R2 - R1) * a1 * (1 - a1) * S1) AS p1 FROM g4 GROUP BY ALL),
pushed AS (SELECT {s}, what, k, CASE WHEN distance > 0 THEN -2 / (coefficient * coefficient * distance * distance * distance) ELSE 0 END AS g
  FROM dist JOIN coef USING ({s}, what, k)),
pulls AS (SELECT {s}, {', '.join(f"sum(g) FILTER (what = '{w}' AND k = {k}) AS {w}{k}" for w, n in (('slope', 2), ('gap', 3), ('rate', 3)) for k in range(n))}
  FROM pushed GROUP BY ALL),
by_value AS (SELECT {s}, unnest(['Rt', 'Rt', 'Rt', 'tslope', 'tslope', 'tpoint', 'tpoint']) AS component, unnest([0, 1, 2, 0, 1, 0, 1]) AS k,
  unnest([r0 + rate0, r1 + rate1, r2 + rate2, s0 + slope0, s1 + slope1, p0 + gap0 - gap1, p1 + gap1 - gap2]) AS g FROM fitted JOIN pulls USING ({s})),
shares AS (SELECT {s}, component, k, g * dv AS by_value, g * dw AS by_warp FROM by_value JOIN bent USING ({s}, component, k)),
slopes AS (SELECT h.child, h.parent, CAST(NULL AS VARCHAR) AS ran, p.effect AS treatment, h.component, CAST(h.k AS INT) AS k, sum(by_value) AS slope
  FROM shares h JOIN pairs p ON p.treatment = h.treatment GROUP BY ALL
  UNION ALL SELECT child, NULL, ran, NULL, CASE component WHEN 'Rt' THEN 'rate' WHEN 'tslope' THEN 'slope' ELSE 'point' END, NULL, sum(by_warp)
  FROM shares WHERE ran <> 'none' GROUP BY ALL)"""


# the same model with every first transition point moved so that its reference value is 38: points crowd and cross
CROWDED = VALUES.replace("vals AS (SELECT", "vals0 AS (SELECT").replace("effects AS (SELECT", """vals AS (SELECT a.parent, a.child, a.treatment, a.component, a.k,
  CASE WHEN a.component = 'tpoint' AND a.k = 0 THEN a.value - b.value + 38 ELSE a.value END AS value FROM vals0 a
  JOIN (SELECT parent, child, value FROM vals0 WHERE treatment = 'ref' AND component = 'tpoint' AND k = 0) b USING (parent, child)),
effects AS (SELECT""")


def walk(step_sql: str, start_sql: str, proposals: int) -> str:
    """A random walk of two places, one proposal a row, as a recursive table."""
    z = lambda i: normal_quantile(f"(({hash32('42', '0', 'child', 'n', str(i))} + 0.5) / 4294967296.0)")
    u = f"(({hash32('42', '0', 'child', 'n', chr(39) + 'accept' + chr(39))} + 0.5) / 4294967296.0)"
    return f"""
walk AS (SELECT child, 0::BIGINT AS n, x0, x1, {step_sql} AS lp, 0::BIGINT AS accepted, false AS went, 1.0::DOUBLE AS ratio FROM ({start_sql})
  UNION ALL SELECT child, n + 1, CASE WHEN yes THEN y0 ELSE x0 END, CASE WHEN yes THEN y1 ELSE x1 END, CASE WHEN yes THEN lp1 ELSE lp END,
    accepted + yes::INT, yes, p FROM (SELECT *, {u} < p AS yes FROM (SELECT *, exp(least(0, lp1 - lp)) AS p FROM
    (SELECT child, n, x0, x1, lp, accepted, y0, y1, {step_sql.replace('x0', 'y0').replace('x1', 'y1')} AS lp1 FROM
     (SELECT w.child, n, x0, x1, lp, accepted, m, c, x0 + 0.4 * {z(0)} AS y0, x1 + 0.4 * {z(1)} AS y1 FROM walk w JOIN bowl USING (child) WHERE n < {proposals}))))
)"""
