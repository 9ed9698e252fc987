"""Action shares, bet sizes, preflop and postflop dynamics: 75 features of a chunk."""

from __future__ import annotations

from quillon.functions.sql import AGG, BLIND, RAISE, STREETS, VOLUNTARY, Dialect, Flow, count_if, cv, div, joined, near, quantile, share

# Fractions of the pot and sizes in big blinds that count as common.
POT_FRACTIONS, POT_TOLERANCE = (0.25, 0.33, 0.5, 0.66, 0.75, 1.0), 0.04
COMMON_BB, COMMON_TOLERANCE = (2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 7.5, 10.0, 15.0, 20.0, 25.0), 0.30
NEAR_INTEGER = 0.15


def flow(d: Dialect, digits: int | None = None, only: tuple[str, ...] = ()) -> Flow:
    whole = f"abs(v - {d.rint('v')})"
    f = Flow()
    f.step("nb", f"SELECT * FROM act WHERE kind NOT IN {BLIND}")
    f.step("ch", f"SELECT chunk_id, count(*) AS n_hands, avg(n_streets) AS avg_streets, avg(n_players) AS avg_players, {share('n_streets = 0')} AS preflop_only, {share('n_streets >= 3')} AS river, {share('showdown')} AS showdown FROM hand GROUP BY chunk_id")
    f.step("shares", f"SELECT chunk_id, count(*) AS m, {', '.join(f'{count_if(f"kind = {k!r}")} AS n_{k}' for k in ('fold', 'call', 'check', 'all_in'))}, {count_if(f'kind IN {AGG}')} AS n_agg FROM nb GROUP BY chunk_id")
    f.step("streets", f"SELECT chunk_id, street, {div(count_if(f'kind IN {AGG}'), 'count(*)')} AS q FROM nb WHERE street IN {STREETS} GROUP BY chunk_id, street")
    f.step("street_agg", f"SELECT chunk_id, {', '.join(f'max(CASE WHEN street = {s!r} THEN q END) AS q_{s}' for s in STREETS)}, {cv('q')} AS q_cv FROM streets GROUP BY chunk_id")
    f.step("per_hand", f"SELECT h.chunk_id, h.hand_ix, count(a.kind) AS n FROM hand h LEFT JOIN nb a ON a.chunk_id = h.chunk_id AND a.hand_ix = h.hand_ix GROUP BY h.chunk_id, h.hand_ix")
    f.step("lengths", "SELECT chunk_id, avg(n) AS n_mean, stddev_pop(n) AS n_std FROM per_hand GROUP BY chunk_id")
    # bets
    f.step("bets", "SELECT *, amt_bb AS v, CASE WHEN pot_before > 0 THEN amount / pot_before END AS pct FROM act WHERE kind IN ('bet', 'raise') AND amt_bb > 0")
    pre, post = "CASE WHEN street = 'preflop' THEN {} END", "CASE WHEN street IN ('flop', 'turn', 'river') THEN {} END"
    is_near = f"CAST({whole} < {NEAR_INTEGER} AS INT)"
    f.step(
        "sizes",
        f"""SELECT chunk_id, avg(v) AS v_mean, stddev_pop(v) AS v_std, {cv('v')} AS v_cv, max(v) AS v_max,
        {', '.join(f'{quantile("v", q)} AS v_{int(q * 100)}' for q in (0.1, 0.25, 0.5, 0.75, 0.9))},
        avg(pct) AS p_mean, stddev_pop(pct) AS p_std, {cv('pct')} AS p_cv, {quantile('pct', 0.1)} AS p_10, {quantile('pct', 0.9)} AS p_90,
        count(DISTINCT {d.rint('pct / 0.1')}) AS p_kinds, count(pct) AS p_n, {share(near('pct', POT_FRACTIONS, POT_TOLERANCE))} AS p_round,
        avg({is_near}) AS near_int, {share(near('v', COMMON_BB, COMMON_TOLERANCE))} AS common, avg({whole}) AS dist, {quantile(whole, 0.5)} AS dist_50,
        {share(f'abs(v - {d.rint("v * 2")} / 2) < 0.10')} AS near_half, avg({pre.format(is_near)}) AS near_pre, avg({post.format(is_near)}) AS near_post FROM bets GROUP BY chunk_id""",
    )
    f.entropy("pct_h", "bets", d.rint("pct / 0.1"), where="pct IS NOT NULL")
    f.entropy("bb_h", "bets", d.rint("v / 1.0"))
    f.entropy("dec_h", "bets", d.rint("(v - floor(v)) / 0.1"))
    f.step("street_v", f"SELECT chunk_id, street, avg(v) AS v FROM bets WHERE street IN {STREETS} GROUP BY chunk_id, street")
    f.step("street_bb", f"SELECT chunk_id, {', '.join(f'max(CASE WHEN street = {s!r} THEN v END) AS v_{s}' for s in STREETS)}, {cv('v')} AS v_street_cv FROM street_v GROUP BY chunk_id")
    f.step("seat_v", f"SELECT chunk_id, seat, count(pct) AS np, avg(pct) AS mp, {cv('pct')} AS cp, count(v) AS nv, avg(v) AS mv, {cv('v')} AS c_v, avg({is_near}) AS ni FROM bets WHERE seat <> 0 GROUP BY chunk_id, seat")
    two = lambda n, e: f"CASE WHEN {count_if(f'{n} >= 3')} >= 2 THEN {e} END"
    thrice = lambda n, x: f"CASE WHEN {n} >= 3 THEN {x} END"
    f.step(
        "seats",
        f"""SELECT chunk_id, avg({thrice('np', 'cp')}) AS cp_mean, min({thrice('np', 'cp')}) AS cp_min,
        {two('np', f"max({thrice('np', 'mp')}) - min({thrice('np', 'mp')})")} AS mp_range, {two('np', f"stddev_pop({thrice('np', 'mp')})")} AS mp_std,
        min({thrice('nv', 'ni')}) AS ni_min, max({thrice('nv', 'ni')}) AS ni_max,
        {two('nv', f"max({thrice('nv', 'mv')}) - min({thrice('nv', 'mv')})")} AS mv_range, {two('nv', f"stddev_pop({thrice('nv', 'mv')})")} AS mv_std,
        avg({thrice('nv', 'c_v')}) AS cv_mean, min({thrice('nv', 'c_v')}) AS cv_min FROM seat_v GROUP BY chunk_id""",
    )
    # seats over hands
    f.step(
        "seat_hand",
        f"""SELECT p.chunk_id, p.hand_ix, p.seat, max(CASE WHEN a.street = 'preflop' AND a.kind IN {VOLUNTARY} THEN 1 ELSE 0 END) AS vpip,
        max(CASE WHEN a.street = 'preflop' AND a.kind IN {RAISE} THEN 1 ELSE 0 END) AS pfr, max(CASE WHEN a.kind = 'fold' THEN 1 ELSE 0 END) AS folded,
        max(CASE WHEN a.street = 'preflop' AND a.kind NOT IN {BLIND} THEN 1 ELSE 0 END) AS acted
        FROM (SELECT DISTINCT chunk_id, hand_ix, seat FROM play WHERE seat IS NOT NULL) p
        LEFT JOIN act a ON a.chunk_id = p.chunk_id AND a.hand_ix = p.hand_ix AND a.seat = p.seat GROUP BY p.chunk_id, p.hand_ix, p.seat""",
    )
    f.step("seat_mean", "SELECT chunk_id, seat, avg(vpip) AS vpip, avg(pfr) AS pfr, avg(folded) AS folded FROM seat_hand GROUP BY chunk_id, seat")
    f.step("styles", f"SELECT chunk_id, {', '.join(f'avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std' for c in ('vpip', 'pfr', 'folded'))} FROM seat_mean GROUP BY chunk_id")
    # tumbling windows of an eighth of the hands
    f.step("win_of", "SELECT h.chunk_id, h.hand_ix, CAST(floor(h.hand_ix / greatest(CAST(5 AS DOUBLE), floor(CAST(c.n_hands AS DOUBLE) / 8))) AS INT) AS w FROM hand h JOIN ch c ON c.chunk_id = h.chunk_id")
    f.step("win_n", "SELECT chunk_id, w FROM win_of GROUP BY chunk_id, w HAVING count(*) >= 3")
    f.step("win_fold", f"SELECT o.chunk_id, o.w, CAST(coalesce({count_if("a.kind = 'fold'")}, 0) AS DOUBLE) / greatest(1, {count_if("a.kind IN ('call', 'check', 'bet', 'raise', 'fold', 'all_in')")}) AS q FROM win_of o JOIN win_n k ON k.chunk_id = o.chunk_id AND k.w = o.w LEFT JOIN nb a ON a.chunk_id = o.chunk_id AND a.hand_ix = o.hand_ix GROUP BY o.chunk_id, o.w")
    f.step("win_vpip", "SELECT o.chunk_id, o.w, avg(s.vpip) AS q FROM win_of o JOIN win_n k ON k.chunk_id = o.chunk_id AND k.w = o.w JOIN seat_hand s ON s.chunk_id = o.chunk_id AND s.hand_ix = o.hand_ix WHERE s.acted = 1 AND s.seat <> 0 GROUP BY o.chunk_id, o.w")
    f.step("fold_time", f"SELECT chunk_id, {cv('q')} AS c FROM win_fold GROUP BY chunk_id")
    f.step("vpip_time", f"SELECT chunk_id, {cv('q')} AS c FROM win_vpip GROUP BY chunk_id")
    # preflop and flop dynamics of a hand
    f.step("pre_hand", f"SELECT chunk_id, hand_ix, {count_if(f'kind IN {RAISE}')} AS r, min(CASE WHEN kind IN {RAISE} THEN act_ix END) AS r0, min(CASE WHEN kind = 'call' THEN act_ix END) AS c0, max_by(seat, act_ix) FILTER (WHERE kind IN {RAISE}) AS raiser FROM nb WHERE street = 'preflop' GROUP BY chunk_id, hand_ix")
    f.step("flop_hand", "SELECT chunk_id, hand_ix, min_by(kind, act_ix) FILTER (WHERE kind <> 'check') AS k, min_by(seat, act_ix) FILTER (WHERE kind <> 'check') AS s FROM act WHERE street = 'flop' GROUP BY chunk_id, hand_ix")
    f.step("pre", f"SELECT p.chunk_id, {count_if('p.r >= 2')} AS n3, {count_if('p.r >= 3')} AS n4, {count_if('p.c0 IS NOT NULL AND (p.r0 IS NULL OR p.c0 < p.r0)')} AS limps, {count_if('p.raiser IS NOT NULL AND q.hand_ix IS NOT NULL')} AS chances, {count_if(f'p.raiser IS NOT NULL AND q.k IN {AGG} AND q.s = p.raiser')} AS cbets FROM pre_hand p LEFT JOIN flop_hand q ON q.chunk_id = p.chunk_id AND q.hand_ix = p.hand_ix GROUP BY p.chunk_id")
    f.step("check_raise", f"SELECT chunk_id, hand_ix, street, seat FROM act WHERE street IN ('flop', 'turn', 'river') AND seat <> 0 GROUP BY chunk_id, hand_ix, street, seat HAVING min(CASE WHEN kind = 'check' THEN act_ix END) < max(CASE WHEN kind IN {RAISE} THEN act_ix END)")
    f.step("check_raises", "SELECT chunk_id, count(*) AS n FROM check_raise GROUP BY chunk_id")
    zero = lambda a: f"coalesce({div(a, 'greatest(coalesce(shares.m, 0), 1)')}, 0)"
    per = lambda a: f"coalesce({div(a, 'ch.n_hands')}, 0)"
    columns = {
        "n_hands": "ch.n_hands", "fold_rate": zero("shares.n_fold"), "call_rate": zero("shares.n_call"), "raise_rate": zero("shares.n_agg"), "check_rate": zero("shares.n_check"),
        "avg_streets": "ch.avg_streets", "avg_players": "ch.avg_players", "preflop_only_rate": "ch.preflop_only", "river_rate": "ch.river",
        "bet_mean_bb": "sizes.v_mean", "bet_std_bb": "sizes.v_std", "bet_cv": "sizes.v_cv", "bet_entropy": "pct_h.h", "n_distinct_pot_pcts": "CASE WHEN sizes.p_n > 0 THEN sizes.p_kinds END",
        "pot_pct_mean": "sizes.p_mean", "pot_pct_std": "sizes.p_std", "pot_pct_cv": "sizes.p_cv",
        "vpip_mean": "styles.vpip_mean", "vpip_std": "styles.vpip_std", "pfr_mean": "styles.pfr_mean", "pfr_std": "styles.pfr_std", "fold_mean": "styles.folded_mean", "fold_std": "styles.folded_std",
        "fold_cv_time": "fold_time.c", "vpip_cv_time": "vpip_time.c",
        "bet_mode_concentration": "pct_h.top", "bet_top3_concentration": "pct_h.top3", "round_frac_rate": "sizes.p_round",
        "pot_pct_p10": "sizes.p_10", "pot_pct_p90": "sizes.p_90", "pot_pct_p90_p10": "sizes.p_90 - sizes.p_10",
        "seat_betsize_cv_mean": "seats.cp_mean", "seat_betsize_cv_min": "seats.cp_min", "seat_pot_pct_range": "seats.mp_range", "seat_pot_pct_std_of_mean": "seats.mp_std",
        **{f"agg_freq_{s}": f"street_agg.q_{s}" for s in STREETS}, "agg_freq_street_cv": "street_agg.q_cv",
        "threebet_rate": per("pre.n3"), "fourbet_rate": per("pre.n4"), "limp_rate": per("pre.limps"), "cbet_rate": div("pre.cbets", "pre.chances"), "checkraise_per_hand": per("check_raises.n"),
        "allin_rate": zero("shares.n_all_in"), "showdown_rate": "ch.showdown", "actions_per_hand_mean": "lengths.n_mean", "actions_per_hand_std": "lengths.n_std",
        **{f"bet_mean_bb_{s}": f"street_bb.v_{s}" for s in STREETS}, "bet_mean_bb_street_cv": "street_bb.v_street_cv",
        "bet_median_bb": "sizes.v_50", "bet_p10_bb": "sizes.v_10", "bet_p90_bb": "sizes.v_90", "bet_iqr_bb": "sizes.v_75 - sizes.v_25", "bet_max_bb": "sizes.v_max", "bet_bb_entropy": "bb_h.h",
        "near_integer_bb_rate": "sizes.near_int", "common_bb_rate": "sizes.common", "mean_distance_to_int_bb": "sizes.dist", "median_distance_to_int_bb": "sizes.dist_50", "near_half_bb_rate": "sizes.near_half", "bet_decimal_entropy": "dec_h.h",
        "near_integer_bb_rate_preflop": "sizes.near_pre", "near_integer_bb_rate_postflop": "sizes.near_post",
        "seat_near_integer_bb_min": "seats.ni_min", "seat_near_integer_bb_max": "seats.ni_max", "seat_near_integer_bb_range": "seats.ni_max - seats.ni_min",
        "seat_bet_mean_bb_range": "seats.mv_range", "seat_bet_mean_bb_std_of_mean": "seats.mv_std", "seat_bet_bb_cv_mean": "seats.cv_mean", "seat_bet_bb_cv_min": "seats.cv_min",
    }
    f.last = joined("ch", ["shares", "street_agg", "lengths", "sizes", "pct_h", "bb_h", "dec_h", "street_bb", "seats", "styles", "fold_time", "vpip_time", "pre", "check_raises"], columns, digits=digits, only=only)
    return f
