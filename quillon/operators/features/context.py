"""Decisions by context, position curves, pot fractions and street shape: 22 features of a chunk."""

from __future__ import annotations

from quillon.functions.sql import AGG, BLIND, RAISE, STREETS, VOLUNTARY, Dialect, Flow, count_if, div, joined, share

# Round fractions of the pot.
ROUND = (0.33, 0.5, 0.66, 0.75, 1.0)


def flow(d: Dialect, digits: int | None = None, only: tuple[str, ...] = (), hero_only: bool = False) -> Flow:
    f = Flow()
    mine = "seat = hero_seat" if hero_only else "TRUE"
    f.step("ch", "SELECT chunk_id, count(*) AS n_hands FROM hand GROUP BY chunk_id")
    f.step(
        "nb",
        f"""SELECT a.*, h.n_players, h.hero_seat,
        coalesce(max(CASE WHEN a.kind IN {AGG} THEN 1 ELSE 0 END) OVER (PARTITION BY a.chunk_id, a.hand_ix, a.street ORDER BY a.act_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS facing
        FROM act a JOIN hand h ON h.chunk_id = a.chunk_id AND h.hand_ix = a.hand_ix WHERE a.kind NOT IN {BLIND}""",
    )
    f.step("own", f"SELECT * FROM nb WHERE {mine}")
    f.step("ctx_src", "SELECT chunk_id, street, least(n_players, 6) AS np, facing, kind FROM own WHERE kind <> ''")
    f.entropy("ctx", "ctx_src", "kind", by="chunk_id, street, np, facing")
    big = lambda x: f"CASE WHEN total >= 5 THEN {x} END"
    f.step("ctxs", f"SELECT chunk_id, avg({big('h')}) AS hm, stddev_pop({big('h')}) AS hs, avg({big('top')}) AS dm, stddev_pop({big('top')}) AS ds, count(*) AS n FROM ctx GROUP BY chunk_id")
    # curves over the order of preflop actions
    f.step("pos", "SELECT *, row_number() OVER (PARTITION BY chunk_id, hand_ix ORDER BY act_ix) - 1 AS k FROM nb WHERE street = 'preflop'")
    agg_q, vpip_q = share(f"kind IN {RAISE}"), share(f"kind IN {VOLUNTARY}")
    f.step("curve", f"SELECT chunk_id, k, {agg_q} AS a, {vpip_q} AS v FROM pos WHERE k < 6 AND {mine} GROUP BY chunk_id, k HAVING count(*) >= 8")
    f.step("curve_d", "SELECT chunk_id, k, a, v, a - lag(a) OVER w AS da, v - lag(v) OVER w AS dv FROM curve WINDOW w AS (PARTITION BY chunk_id ORDER BY k)")
    f.step("curve_2", "SELECT *, da - lag(da) OVER (PARTITION BY chunk_id ORDER BY k) AS dda FROM curve_d")
    mono = lambda x: f"CASE WHEN count(*) >= 3 AND {count_if(f'{x} <> 0')} > 0 THEN CAST(greatest({count_if(f'{x} > 0')}, {count_if(f'{x} < 0')}) AS DOUBLE) / (count(*) - 1) END"
    f.step("curves", f"SELECT chunk_id, {mono('da')} AS ma, {mono('dv')} AS mv, CASE WHEN count(*) >= 2 THEN max(a) - min(a) END AS ra, CASE WHEN count(*) >= 2 THEN max(v) - min(v) END AS rv, CASE WHEN count(*) >= 3 THEN stddev_pop(dda) END AS rough FROM curve_2 GROUP BY chunk_id")
    # pot fractions
    f.step("fr", "SELECT chunk_id, amount / pot_before AS x FROM own WHERE kind IN ('bet', 'raise') AND amount <> 0 AND pot_before > 0 AND amount / pot_before > 0 AND amount / pot_before < 5")
    dist = "least(" + ", ".join(f"abs(x - {t})" for t in ROUND) + ")"
    f.step("frs", f"SELECT chunk_id, avg(x) AS m, stddev_pop(x) AS s, {share(f'{dist} < 0.05')} AS near_round, avg({dist}) AS dist, count(DISTINCT {d.rint('x * 100')}) AS kinds FROM fr GROUP BY chunk_id")
    f.entropy("fr_h", "fr", d.rint("x * 10"))
    # kinds of action
    f.entropy("kind_h", "own", "kind")
    f.step("kind_r", "SELECT chunk_id, c, row_number() OVER (PARTITION BY chunk_id ORDER BY c, k) AS i, count(*) OVER (PARTITION BY chunk_id) AS n, sum(c) OVER (PARTITION BY chunk_id) AS t FROM kind_h_n")
    f.step("gini", "SELECT chunk_id, 2 * sum(i * CAST(c AS DOUBLE)) / (max(n) * max(t)) - (max(n) + CAST(1 AS DOUBLE)) / max(n) AS g FROM kind_r GROUP BY chunk_id")
    # aggression by street
    order = "CASE street " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STREETS)) + " END"
    st_q = share(f"kind IN {AGG}")
    f.step("st", f"SELECT chunk_id, {order} AS o, {st_q} AS q FROM own WHERE street IN {STREETS} GROUP BY chunk_id, {order}")
    f.step("st_i", "SELECT chunk_id, o, q, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY o) AS DOUBLE) AS i FROM st")
    f.step("shape", "SELECT chunk_id, CASE WHEN count(*) >= 2 THEN regr_slope(q, i) END AS slope, CASE WHEN count(*) >= 2 THEN min_by(q, o) - max_by(q, o) END AS drop_off FROM st_i GROUP BY chunk_id")
    # heads-up and multiway
    f.step("acting", "SELECT chunk_id, hand_ix, count(DISTINCT seat) AS n FROM nb GROUP BY chunk_id, hand_ix")
    side = lambda op: (count_if(f"n.n {op} 2 AND a.kind = 'fold'"), count_if(f"n.n {op} 2"))
    (fh, th), (fm, tm) = side("<="), side(">")
    f.step("multi", f"SELECT a.chunk_id, CASE WHEN {th} >= 10 AND {tm} >= 10 THEN {div(fh, th)} - {div(fm, tm)} END AS diff FROM own a JOIN acting n ON n.chunk_id = a.chunk_id AND n.hand_ix = a.hand_ix GROUP BY a.chunk_id")
    columns = {
        "gto_ctx_entropy_mean": "ctxs.hm", "gto_ctx_entropy_std": "ctxs.hs", "gto_ctx_dominance_mean": "ctxs.dm", "gto_ctx_dominance_std": "ctxs.ds", "gto_n_contexts": "coalesce(ctxs.n, 0)",
        "pos_agg_monotonicity": "curves.ma", "pos_vpip_monotonicity": "curves.mv", "pos_agg_range": "curves.ra", "pos_vpip_range": "curves.rv", "pos_agg_roughness": "curves.rough",
        "potfrac_mean": "frs.m", "potfrac_std": "frs.s", "potfrac_cv": "frs.s / (frs.m + 1e-9)", "potfrac_round_rate": "frs.near_round", "potfrac_dist_to_round_mean": "frs.dist", "potfrac_n_unique": "frs.kinds", "potfrac_entropy": "fr_h.h",
        "action_type_gini": "gini.g", "action_type_entropy": "kind_h.h", "street_agg_slope": "shape.slope", "street_agg_dropoff": "shape.drop_off", "fold_hu_vs_mw_diff": "multi.diff",
    }
    f.last = joined("ch", ["ctxs", "curves", "frs", "fr_h", "gini", "kind_h", "shape", "multi"], columns, digits=digits, only=only)
    return f
