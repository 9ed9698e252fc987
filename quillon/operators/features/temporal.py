"""Stack continuity, action sequences, order effects and independence over time: 39 features of a chunk."""

from __future__ import annotations

from quillon.functions.sql import AGG, BLIND, RAISE, VOLUNTARY, Dialect, Flow, count_if, cv, div, joined, share

WINDOW = 10


def flow(d: Dialect, digits: int | None = None, only: tuple[str, ...] = ()) -> Flow:
    f = Flow()
    f.step("nb", f"SELECT * FROM act WHERE kind NOT IN {BLIND}")
    f.step("ch", "SELECT chunk_id, count(*) AS n_hands FROM hand GROUP BY chunk_id")
    # stacks
    f.step("st", "SELECT *, max(stack) OVER (PARTITION BY chunk_id) AS cap FROM play WHERE stack IS NOT NULL AND seat IS NOT NULL")
    f.step("st_all", f"SELECT chunk_id, max(cap) AS cap, {share('abs(stack - cap) < 1e-9')} AS at_cap, {div('count(DISTINCT stack)', 'count(*)')} AS uniq FROM st GROUP BY chunk_id")
    f.step("st_lag", "SELECT chunk_id, stack, cap, hand_ix, lag(stack) OVER w AS s0, lag(hand_ix) OVER w AS h0 FROM st WINDOW w AS (PARTITION BY chunk_id, seat ORDER BY hand_ix)")
    f.step("st_d", f"SELECT chunk_id, avg(abs(stack - s0)) AS mean_abs, stddev_pop(stack - s0) AS sd, {share('abs(stack - s0) < 1e-9')} AS zero, {share('abs(stack - cap) < 1e-9 AND s0 < cap - 1e-9')} AS topup, {share('stack - s0 > 1e-9')} AS gain FROM st_lag WHERE hand_ix - h0 = 1 GROUP BY chunk_id")
    # sequences within a street of a hand
    f.step("seq", "SELECT chunk_id, kind, lag(kind) OVER (PARTITION BY chunk_id, hand_ix, street ORDER BY act_ix) AS prev FROM nb WHERE street <> '' AND kind <> ''")
    f.entropy("uni", "seq", "kind")
    f.entropy("bi", "seq", "concat(prev, '>', kind)", where="prev IS NOT NULL")
    f.step("rep", f"SELECT chunk_id, {share('prev = kind')} AS q FROM seq WHERE prev IS NOT NULL GROUP BY chunk_id")
    f.step("bg", "SELECT chunk_id, prev, kind, count(*) AS c FROM seq WHERE prev IS NOT NULL GROUP BY chunk_id, prev, kind")
    f.step("bg_t", "SELECT *, sum(c) OVER (PARTITION BY chunk_id) AS n, sum(c) OVER (PARTITION BY chunk_id, prev) AS np FROM bg")
    f.step("cond", "SELECT chunk_id, -sum(CAST(c AS DOUBLE) / n * log2(CAST(c AS DOUBLE) / np + 1e-12)) AS h FROM bg_t GROUP BY chunk_id")
    # order of preflop actions
    f.step("pos", "SELECT chunk_id, kind, row_number() OVER (PARTITION BY chunk_id, hand_ix ORDER BY act_ix) - 1 AS k FROM nb WHERE street = 'preflop'")
    pos_raise = share(f"kind IN {RAISE}")
    f.step("pos_k", f"SELECT chunk_id, k, count(*) AS n, avg(CAST((kind = 'fold') AS INT)) AS qf, {pos_raise} AS qr FROM pos WHERE k < 6 GROUP BY chunk_id, k")
    f.step("pos_all", "SELECT chunk_id, max(CASE WHEN k = 0 THEN qf END) AS f0, max(CASE WHEN k = 0 THEN qr END) AS r0, CASE WHEN sum(CASE WHEN n >= 10 THEN 1 ELSE 0 END) >= 3 THEN regr_slope(CASE WHEN n >= 10 THEN qf END, CASE WHEN n >= 10 THEN CAST(k AS DOUBLE) END) END AS slope FROM pos_k GROUP BY chunk_id")
    # series over hands
    hand_agg = share(f"kind IN {AGG}")
    f.step("agg_s", f"SELECT chunk_id, hand_ix, {hand_agg} AS x FROM nb GROUP BY chunk_id, hand_ix")
    f.step("seat_v", f"SELECT p.chunk_id, p.hand_ix, p.seat, max(CASE WHEN a.kind IN {VOLUNTARY} THEN 1 ELSE 0 END) AS v FROM (SELECT DISTINCT chunk_id, hand_ix, seat FROM play WHERE seat <> 0) p JOIN nb a ON a.chunk_id = p.chunk_id AND a.hand_ix = p.hand_ix AND a.seat = p.seat WHERE a.street = 'preflop' GROUP BY p.chunk_id, p.hand_ix, p.seat")
    f.step("vpip_s", "SELECT chunk_id, hand_ix, avg(v) AS x FROM seat_v GROUP BY chunk_id, hand_ix")
    for s in ("agg", "vpip"):
        f.step(f"{s}_lag", f"SELECT chunk_id, x, lag(x) OVER (PARTITION BY chunk_id ORDER BY hand_ix) AS x0, row_number() OVER (PARTITION BY chunk_id ORDER BY hand_ix) AS rn, count(*) OVER (PARTITION BY chunk_id) AS n FROM {s}_s")
        # a constant series has no correlation: guarded, since engines disagree on it
        f.step(f"{s}_var", f"SELECT chunk_id, max(n) AS n, stddev_pop(x) AS s1, stddev_pop(x0) AS s0, avg(x * x0) - avg(x) * avg(x0) AS c FROM {s}_lag WHERE x0 IS NOT NULL GROUP BY chunk_id")
    f.step("halves", "SELECT chunk_id, CASE WHEN max(n) >= 10 THEN abs(avg(CASE WHEN rn <= floor(CAST(n AS DOUBLE) / 2) THEN x END) - avg(CASE WHEN rn > floor(CAST(n AS DOUBLE) / 2) THEN x END)) END AS q FROM agg_lag GROUP BY chunk_id")
    # runs test and dispersion of each seat
    f.step("run_l", "SELECT chunk_id, seat, v, lag(v) OVER w AS v0, row_number() OVER w - 1 AS i FROM seat_v WINDOW w AS (PARTITION BY chunk_id, seat ORDER BY hand_ix)")
    f.step("run_n", f"SELECT chunk_id, seat, count(*) AS n, CAST(sum(v) AS DOUBLE) AS n1, CAST(count(*) - sum(v) AS DOUBLE) AS n0, 1 + {count_if('v <> v0')} AS runs, avg(v) AS p FROM run_l GROUP BY chunk_id, seat")
    f.step("run_m", "SELECT *, 2 * n1 * n0 / n + 1 AS mu, 2 * n1 * n0 * (2 * n1 * n0 - n) / (CAST(n AS DOUBLE) * n * (n - 1)) AS var FROM run_n WHERE n >= 12 AND n1 >= 3 AND n0 >= 3")
    f.step("runs", "SELECT chunk_id, avg((runs - mu) / sqrt(var)) AS z, avg(abs((runs - mu) / sqrt(var))) AS az FROM run_m WHERE var > 0 GROUP BY chunk_id")
    f.step("win", f"SELECT chunk_id, seat, floor(i / CAST({WINDOW} AS DOUBLE)) AS w, avg(v) AS q FROM run_l GROUP BY chunk_id, seat, floor(i / CAST({WINDOW} AS DOUBLE)) HAVING count(*) = {WINDOW}")
    f.step("disp_s", f"SELECT k.chunk_id, k.seat, var_pop(w.q) / (max(k.p) * (1 - max(k.p)) / {WINDOW}) AS q FROM run_n k JOIN win w ON w.chunk_id = k.chunk_id AND w.seat = k.seat WHERE k.n >= {3 * WINDOW} AND k.p > 0.05 AND k.p < 0.95 GROUP BY k.chunk_id, k.seat HAVING count(*) >= 3")
    f.step("disp", "SELECT chunk_id, avg(q) AS q FROM disp_s GROUP BY chunk_id")
    # ratios of raises
    f.step("rr", f"SELECT chunk_id, hand_ix, act_ix, raise_to AS r1, lag(raise_to) OVER (PARTITION BY chunk_id, hand_ix ORDER BY act_ix) AS r0 FROM act WHERE street = 'preflop' AND kind IN {RAISE} AND raise_to <> 0")
    f.step("rr_all", f"SELECT chunk_id, avg(r1 / r0) AS m, stddev_pop(r1 / r0) AS s, {cv('r1 / r0')} AS c FROM rr WHERE r0 > 0 GROUP BY chunk_id")
    f.step("last_r", "SELECT chunk_id, hand_ix, max_by(r1, act_ix) AS r FROM rr GROUP BY chunk_id, hand_ix")
    f.step("flop_b", f"SELECT chunk_id, hand_ix, min_by(amount, act_ix) AS b FROM act WHERE street = 'flop' AND kind IN {AGG} GROUP BY chunk_id, hand_ix")
    f.step("fp", f"SELECT r.chunk_id, avg(b.b / r.r) AS m, {cv('b.b / r.r')} AS c FROM last_r r JOIN flop_b b ON b.chunk_id = r.chunk_id AND b.hand_ix = r.hand_ix WHERE b.b > 0 AND r.r > 0 GROUP BY r.chunk_id")
    f.step("cap_r", f"SELECT a.chunk_id, {share('coalesce(a.raise_to >= 0.93 * s.cap, FALSE)')} AS q FROM act a LEFT JOIN st_all s ON s.chunk_id = a.chunk_id WHERE a.raise_to <> 0 GROUP BY a.chunk_id")
    # table composition
    f.step("tab", "SELECT chunk_id, hand_ix, n_players, lag(n_players) OVER (PARTITION BY chunk_id ORDER BY hand_ix) AS p0 FROM hand")
    f.step("tabs", f"SELECT chunk_id, {share('n_players = 2')} AS hu, {share('n_players >= 5')} AS full_ring, {share('n_players <> p0')} AS change FROM tab GROUP BY chunk_id")
    f.step("seats", "SELECT DISTINCT chunk_id, hand_ix, seat FROM play WHERE seat <> 0")
    f.step("seat_n", "SELECT h.chunk_id, h.hand_ix, count(s.seat) AS n FROM hand h LEFT JOIN seats s ON s.chunk_id = h.chunk_id AND s.hand_ix = h.hand_ix GROUP BY h.chunk_id, h.hand_ix")
    f.step("seat_2", "SELECT chunk_id, hand_ix, n, lag(n) OVER w AS n0, lag(hand_ix) OVER w AS h0 FROM seat_n WINDOW w AS (PARTITION BY chunk_id ORDER BY hand_ix)")
    f.step("kept_seats", "SELECT a.chunk_id, a.hand_ix, count(*) AS c FROM seat_2 q JOIN seats a ON a.chunk_id = q.chunk_id AND a.hand_ix = q.hand_ix JOIN seats b ON b.chunk_id = q.chunk_id AND b.hand_ix = q.h0 AND b.seat = a.seat GROUP BY a.chunk_id, a.hand_ix")
    f.step("jac", "SELECT q.chunk_id, CAST(coalesce(b.c, 0) AS DOUBLE) / (q.n + q.n0 - coalesce(b.c, 0)) AS j FROM seat_2 q LEFT JOIN kept_seats b ON b.chunk_id = q.chunk_id AND b.hand_ix = q.hand_ix WHERE q.h0 IS NOT NULL AND q.n + q.n0 > 0")
    f.step("jacs", "SELECT chunk_id, avg(j) AS m, min(j) AS lo FROM jac GROUP BY chunk_id")
    f.entropy("hero_h", "hand", "hero_seat", where="hero_seat IS NOT NULL")
    f.step("acts", f"SELECT h.chunk_id, h.hand_ix, count(a.kind) AS n, {count_if(f'a.kind IN {VOLUNTARY}')} AS v FROM hand h LEFT JOIN nb a ON a.chunk_id = h.chunk_id AND a.hand_ix = h.hand_ix GROUP BY h.chunk_id, h.hand_ix")
    f.step("act_all", f"SELECT chunk_id, {share('v = 0')} AS walk, {share('n <= 1')} AS one FROM acts GROUP BY chunk_id")
    f.entropy("len_h", "acts", "n")
    corr = lambda s: f"CASE WHEN {s}_var.n >= 5 AND {s}_var.s1 > 1e-9 AND {s}_var.s0 > 1e-9 THEN {s}_var.c / ({s}_var.s1 * {s}_var.s0) END"
    columns = {
        "stack_at_cap_rate": "st_all.at_cap", "stack_delta_abs_mean": "st_d.mean_abs", "stack_delta_std": "st_d.sd", "stack_delta_zero_rate": "st_d.zero", "stack_topup_rate": "st_d.topup", "stack_gain_rate": "st_d.gain", "stack_unique_ratio": "st_all.uniq",
        "action_unigram_entropy": "uni.h", "action_bigram_entropy": "bi.h", "action_repeat_rate": "rep.q", "bigram_top1_share": "bi.top", "bigram_top3_share": "bi.top3", "action_cond_entropy": "cond.h",
        "fold_rate_first_to_act": "pos_all.f0", "raise_rate_first_to_act": "pos_all.r0", "fold_pos_slope": "pos_all.slope", "first_action_fold_share": "pos_all.f0",
        "agg_lag1_autocorr": corr("agg"), "vpip_lag1_autocorr": corr("vpip"), "agg_halves_absdiff": "halves.q", "vpip_runs_z_mean": "runs.z", "vpip_runs_absz_mean": "runs.az", "vpip_dispersion_ratio": "disp.q",
        "reraise_ratio_mean": "rr_all.m", "reraise_ratio_std": "rr_all.s", "reraise_ratio_cv": "rr_all.c", "flop_vs_pf_ratio_mean": "fp.m", "flop_vs_pf_ratio_cv": "fp.c", "near_cap_raise_rate": "cap_r.q",
        "frac_headsup": "tabs.hu", "frac_fullring": "tabs.full_ring", "table_size_change_rate": "tabs.change", "seat_jaccard_mean": "jacs.m", "seat_jaccard_min": "jacs.lo",
        "hero_seat_entropy": "hero_h.h", "hero_seat_mode_share": "hero_h.top", "walk_rate": "act_all.walk", "hand_len_entropy": "len_h.h", "one_action_hand_rate": "act_all.one",
    }
    f.last = joined("ch", ["st_all", "st_d", "uni", "bi", "rep", "cond", "pos_all", "agg_var", "vpip_var", "halves", "runs", "disp", "rr_all", "fp", "cap_r", "tabs", "jacs", "hero_h", "act_all", "len_h"], columns, digits=digits, only=only)
    return f
