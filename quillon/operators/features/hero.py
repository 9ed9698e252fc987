"""The hero against the others: what happened next, raise depth, position, stack to pot, drift: 176 features of a chunk.

The hero of a chunk is the hero seat of its first hand that names one.
Undefined ratios are 0.
"""

from __future__ import annotations

from quillon.functions.sql import AGG, RAISE, STREETS, VOLUNTARY, Dialect, Flow, count_if, div, joined, share

POST = STREETS[1:]
IN_POST = "('flop', 'turn', 'river')"
# Fractions of the pot to which bets snap, within 5 percent.
SNAP = (0.25, 0.33, 0.5, 0.67, 0.75, 1.0, 1.25, 1.5, 2.0)
DEPTHS = (1, 2, 3)
BUCKETS = ("shallow", "medium", "deep")


def flow(d: Dialect, digits: int | None = None, only: tuple[str, ...] = ()) -> Flow:
    f = Flow()
    hs = "chunk_id, hand_ix, street"
    is_a = lambda kind, column="kind": f"{column} = '{kind}'"
    at = lambda s, e: f"CASE WHEN street = '{s}' THEN {e} END"
    f.step("hero", "SELECT chunk_id, min_by(hero_seat, hand_ix) FILTER (WHERE hero_seat IS NOT NULL) AS hero, count(*) AS n_hands FROM hand GROUP BY chunk_id")
    f.step("x0", f"SELECT a.*, h.hero, coalesce(a.seat = h.hero, FALSE) AS mine, a.kind IN {AGG} AS agg FROM act a JOIN hero h ON h.chunk_id = a.chunk_id")
    f.step(
        "x",
        f"""SELECT *, coalesce(max(CASE WHEN agg AND NOT mine THEN 1 ELSE 0 END) OVER (PARTITION BY {hs} ORDER BY act_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hot,
        coalesce(sum(CASE WHEN kind IN {RAISE} AND NOT mine THEN 1 ELSE 0 END) OVER (PARTITION BY {hs} ORDER BY act_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS raised,
        sum(CASE WHEN agg THEN 1 ELSE 0 END) OVER (PARTITION BY {hs} ORDER BY act_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS depth,
        lead(mine) OVER (PARTITION BY {hs} ORDER BY act_ix) AS next_mine, lead(kind) OVER (PARTITION BY {hs} ORDER BY act_ix) AS next_kind,
        lead(mine) OVER (PARTITION BY chunk_id, hand_ix ORDER BY act_ix) AS after_mine, lead(kind) OVER (PARTITION BY chunk_id, hand_ix ORDER BY act_ix) AS after_kind, lead(street) OVER (PARTITION BY chunk_id, hand_ix ORDER BY act_ix) AS after_street,
        CASE WHEN mine AND agg AND kind <> 'all_in' AND pot_before > 0 AND amount > 0 THEN amount / pot_before END AS ratio
        FROM x0""",
        keep=True,
    )
    # fold to aggression
    f.step("fta_h", f"SELECT {hs}, min_by(kind, act_ix) AS k FROM x WHERE mine AND hot = 1 GROUP BY {hs}")
    f.step("fta", "SELECT chunk_id, " + ", ".join(f"{count_if(f'street = {s!r}')} AS n_{s}, {count_if(f'street = {s!r} AND {is_a("fold", "k")}')} AS f_{s}" for s in STREETS) + " FROM fta_h GROUP BY chunk_id")
    # aggression, per street and in all
    f.step("af", "SELECT chunk_id, " + ", ".join(f"{count_if(f'street = {s!r} AND agg')} AS a_{s}, {count_if(f'street = {s!r} AND {is_a("call")}')} AS c_{s}" for s in STREETS) + " FROM x WHERE mine GROUP BY chunk_id")
    # flags of a hand's preflop
    flag = lambda c: f"max(CASE WHEN {c} THEN 1 ELSE 0 END)"
    f.step("pre_h", f"SELECT chunk_id, hand_ix, {flag(f'mine AND kind IN {VOLUNTARY}')} AS vpip, {flag(f'mine AND kind IN {RAISE}')} AS pfr, {flag(f'mine AND kind IN {RAISE} AND raised >= 1')} AS three, {flag(f'mine AND kind IN {RAISE} AND raised = 0')} AS opened FROM x WHERE street = 'preflop' GROUP BY chunk_id, hand_ix")
    f.step("pre", "SELECT h.chunk_id, h.hand_ix, " + ", ".join(f"coalesce(p.{c}, 0) AS {c}" for c in ("vpip", "pfr", "three", "opened")) + " FROM hand h LEFT JOIN pre_h p ON p.chunk_id = h.chunk_id AND p.hand_ix = h.hand_ix", keep=True)
    f.step("pres", "SELECT chunk_id, " + ", ".join(f"avg({c}) AS {c}, stddev_pop({c}) AS {c}_s" for c in ("vpip", "pfr", "three", "opened")) + ", stddev_pop(CASE WHEN vpip = 1 THEN pfr END) AS ratio_s FROM pre GROUP BY chunk_id")
    # giving up after the flop
    f.step("fl_h", f"SELECT chunk_id, hand_ix, min_by(kind, act_ix) AS k0, min(act_ix) AS i0, max(CASE WHEN kind = 'fold' THEN act_ix END) AS fold_at FROM x WHERE mine AND street = 'flop' GROUP BY chunk_id, hand_ix")
    f.step("fl", f"SELECT q.chunk_id, count(*) AS saw, {count_if("contains(h.winners, concat(',', CAST(k.hero AS STRING), ','))")} AS won, {count_if('p.pfr = 1')} AS chances, {count_if(f'p.pfr = 1 AND q.k0 IN {AGG} AND q.fold_at > q.i0')} AS gave, {count_if(is_a("check", "q.k0"))} AS checked, {count_if(is_a("check", "q.k0") + " AND q.fold_at > q.i0")} AS check_fold FROM fl_h q JOIN hand h ON h.chunk_id = q.chunk_id AND h.hand_ix = q.hand_ix JOIN pre p ON p.chunk_id = q.chunk_id AND p.hand_ix = q.hand_ix JOIN hero k ON k.chunk_id = q.chunk_id GROUP BY q.chunk_id")
    # sizes
    snap = "(" + " OR ".join(f"abs(ratio - {t}) <= 0.05 * {t}" for t in SNAP) + ")"
    f.step("sz", f"SELECT chunk_id, stddev_pop(ratio) AS s, {share(snap)} AS snap, " + ", ".join(f"stddev_pop({at(s, 'ratio')}) AS s_{s}, avg({at(s, 'ratio')}) AS m_{s}, avg({at(s, f'CAST({snap} AS INT)')}) AS n_{s}" for s in STREETS) + " FROM x WHERE ratio IS NOT NULL GROUP BY chunk_id")
    f.step("rt", f"SELECT chunk_id, count(*) AS n, count(DISTINCT {d.rint('raise_to * 1000')}) AS u FROM x WHERE mine AND agg AND raise_to > 0 GROUP BY chunk_id")
    # hero's share of aggression by hand and street
    f.step("hs", f"SELECT {hs}, count(*) AS n, avg(CAST(agg AS INT)) AS q, {count_if('agg')} AS b, {count_if(is_a("check"))} AS c FROM x WHERE mine GROUP BY {hs}", keep=True)
    f.step("tr", "SELECT chunk_id, " + ", ".join(f"coalesce(avg({at(s, 'q')}), 0) AS q_{s}" for s in STREETS) + " FROM hs GROUP BY chunk_id")
    rate = "CASE WHEN b + c > 0 THEN CAST(b AS DOUBLE) / (b + c) END"
    f.step("cb", "SELECT chunk_id, " + ", ".join(f"coalesce({div(f'sum({at(s, "b")})', f'sum({at(s, "b + c")})')}, 0) AS r_{s}, coalesce(stddev_pop({at(s, rate)}), 0) AS s_{s}, avg({at(s, rate)}) AS m_{s}" for s in POST) + " FROM hs GROUP BY chunk_id")
    # halves of a chunk
    f.step("hf", "SELECT h.chunk_id, h.hand_ix, h.hand_ix < floor(CAST(k.n_hands AS DOUBLE) / 2) AS early FROM hand h JOIN hero k ON k.chunk_id = h.chunk_id WHERE k.n_hands >= 4")
    two = lambda e: (f"coalesce(avg(CASE WHEN early THEN {e} END), 0)", f"coalesce(avg(CASE WHEN NOT early THEN {e} END), 0)")
    cols = lambda name, e: f"{two(e)[0]} AS {name}_0, {two(e)[1]} AS {name}_1"
    f.step("dr_h", f"SELECT f.chunk_id, {cols('vpip', 'p.vpip')}, {cols('pfr', 'p.pfr')} FROM hf f JOIN pre p ON p.chunk_id = f.chunk_id AND p.hand_ix = f.hand_ix GROUP BY f.chunk_id")
    f.step("dr_a", f"SELECT f.chunk_id, {cols('agg', 'CAST(x.agg AS INT)')}, {cols('fold', f'CAST(({is_a("fold", "x.kind")}) AS INT)')}, {cols('size', 'x.ratio')} FROM hf f JOIN x ON x.chunk_id = f.chunk_id AND x.hand_ix = f.hand_ix WHERE x.mine GROUP BY f.chunk_id")
    # the very next action
    f.step("pb", f"SELECT chunk_id, hand_ix, street, {count_if(is_a("check"))} AS ct, {count_if(f'{is_a("check")} AND next_kind IN {AGG}')} AS cb, {count_if('agg')} AS vb, {count_if(f'agg AND next_kind IN {AGG}')} AS vr FROM x WHERE NOT mine AND next_mine AND street IN {IN_POST} GROUP BY {hs}")
    f.step("pbs", "SELECT chunk_id, " + ", ".join(f"{div(f'sum({at(s, "cb")})', f'sum({at(s, "ct")})')} AS p_{s}, {div(f'sum({at(s, "vr")})', f'sum({at(s, "vb")})')} AS r_{s}, sum({at(s, 'ct')}) AS n_{s}, stddev_pop(CASE WHEN street = '{s}' AND ct > 0 THEN CAST(cb AS DOUBLE) / ct END) AS s_{s}" for s in POST) + " FROM pb GROUP BY chunk_id")
    f.step("rs", f"SELECT x.chunk_id, x.street, x.after_kind AS k, CASE WHEN x.pot_before / CASE WHEN h.bb > 0 THEN h.bb ELSE 0.02 END < 10 THEN 'small' ELSE 'big' END AS pot FROM x JOIN hand h ON h.chunk_id = x.chunk_id AND h.hand_ix = x.hand_ix WHERE NOT x.mine AND x.agg AND x.after_mine AND x.after_street = x.street AND x.street IN {STREETS}", keep=True)
    f.entropy("rs_h", "rs", "k", by="chunk_id, street", kind="plain")
    f.entropy("rs_p", "rs", "k", by="chunk_id, street, pot", kind="plain")
    f.entropy("rs_post", "rs", "k", kind="plain", where=f"street IN {IN_POST}")
    f.step("rs_e", "SELECT chunk_id, " + ", ".join(f"max({at(s, 'h')}) AS h_{s}" for s in STREETS) + " FROM rs_h GROUP BY chunk_id")
    f.step("rs_d", "SELECT chunk_id, " + ", ".join(f"abs(coalesce(max(CASE WHEN street = '{s}' AND pot = 'big' THEN h END), 0) - coalesce(max(CASE WHEN street = '{s}' AND pot = 'small' THEN h END), 0)) AS d_{s}" for s in STREETS) + " FROM rs_p GROUP BY chunk_id")
    was = lambda cond: f"CAST(({cond}) AS INT)"
    f.step("rs_n", "SELECT chunk_id, " + ", ".join(f"{count_if(f'street = {s!r}')} AS n_{s}, avg({at(s, was(is_a("fold", "k")))}) AS f_{s}, avg({at(s, was(is_a("call", "k")))}) AS c_{s}, avg({at(s, was(f"k IN {AGG}"))}) AS r_{s}" for s in STREETS) + " FROM rs GROUP BY chunk_id")
    # raise wars before the flop
    f.step("rw", "SELECT *, max(CASE WHEN mine AND agg THEN depth END) OVER (PARTITION BY chunk_id, hand_ix ORDER BY act_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS own FROM x WHERE street = 'preflop'")
    f.step("rws", f"SELECT chunk_id, {count_if('mine AND depth = 3')} AS h4, {count_if('mine AND depth = 5')} AS h5, {count_if('NOT mine AND ((depth = 3 AND own = 2) OR (depth = 2 AND own = 1))')} AS f3, {count_if('NOT mine AND depth = 4 AND own = 3')} AS f4 FROM rw WHERE agg GROUP BY chunk_id")
    f.step("dp", f"SELECT h.chunk_id, h.hand_ix, {count_if('x.agg')} AS depth FROM hand h LEFT JOIN x ON x.chunk_id = h.chunk_id AND x.hand_ix = h.hand_ix AND x.street = 'preflop' GROUP BY h.chunk_id, h.hand_ix")
    f.step("dps", f"SELECT chunk_id, {share('depth = 1')} AS d1, {share('depth = 2')} AS d2, {share('depth = 3')} AS d3, {share('depth >= 4')} AS d4, max(depth) AS top FROM dp GROUP BY chunk_id")
    f.entropy("dp_h", "dp", "depth", kind="plain")
    f.entropy("da_h", "x", "kind", by="chunk_id, depth", kind="plain", where="street = 'preflop' AND mine AND depth IN (1, 2, 3)")
    f.step("das", "SELECT chunk_id, " + ", ".join(f"max(CASE WHEN depth = {k} THEN h END) AS h_{k}, max(CASE WHEN depth = {k} THEN total END) AS n_{k}" for k in DEPTHS) + " FROM da_h GROUP BY chunk_id")
    # stack to pot on the flop
    f.step("pot", "SELECT chunk_id, hand_ix, min_by(pot_before, act_ix) AS pot FROM act WHERE street = 'flop' GROUP BY chunk_id, hand_ix")
    f.step("stk", "SELECT p.chunk_id, p.hand_ix, min_by(p.stack, p.play_ix) AS stack FROM play p JOIN hero h ON h.chunk_id = p.chunk_id AND h.hero = p.seat GROUP BY p.chunk_id, p.hand_ix")
    f.step("spr", "SELECT t.chunk_id, CASE WHEN s.stack / t.pot < 3 THEN 'shallow' WHEN s.stack / t.pot < 10 THEN 'medium' ELSE 'deep' END AS b, q.q FROM pot t JOIN stk s ON s.chunk_id = t.chunk_id AND s.hand_ix = t.hand_ix JOIN hs q ON q.chunk_id = t.chunk_id AND q.hand_ix = t.hand_ix AND q.street = 'flop' WHERE t.pot > 0 AND s.stack > 0")
    f.step("spr_b", "SELECT chunk_id, b, avg(q) AS q, count(*) AS n FROM spr GROUP BY chunk_id, b")
    f.step("sprs", "SELECT chunk_id, " + ", ".join(f"max(CASE WHEN b = '{b}' THEN q END) AS q_{b}, max(CASE WHEN b = '{b}' THEN n END) AS n_{b}" for b in BUCKETS) + ", stddev_pop(q) AS s, max(q) - min(q) AS r FROM spr_b GROUP BY chunk_id")
    # heads-up and multiway, in and out of position
    f.step("seats", f"SELECT {hs}, count(DISTINCT CASE WHEN kind <> 'fold' THEN seat END) AS n FROM act WHERE street IN {IN_POST} GROUP BY {hs}")
    side = lambda op, e: f"sum(CASE WHEN s.n {op} 2 THEN q.{e} ELSE 0 END)"
    f.step("mw", f"SELECT q.chunk_id, {side('<=', 'b')} AS hb, {side('<=', 'n')} AS hn, {side('>', 'b')} AS mb, {side('>', 'n')} AS mn FROM hs q JOIN seats s ON s.chunk_id = q.chunk_id AND s.hand_ix = q.hand_ix AND s.street = q.street GROUP BY q.chunk_id")
    near = "((h.button_seat - k.hero) % h.max_seats + h.max_seats) % h.max_seats <= 1"
    f.step("ip", f"SELECT q.chunk_id, sum(CASE WHEN {near} THEN q.b ELSE 0 END) AS ib, sum(CASE WHEN {near} THEN q.n ELSE 0 END) AS n_in, sum(CASE WHEN {near} THEN 0 ELSE q.b END) AS ob, sum(CASE WHEN {near} THEN 0 ELSE q.n END) AS n_out FROM hs q JOIN hand h ON h.chunk_id = q.chunk_id AND h.hand_ix = q.hand_ix JOIN hero k ON k.chunk_id = q.chunk_id WHERE h.button_seat IS NOT NULL AND q.street IN {IN_POST} GROUP BY q.chunk_id")
    # entropies of hero's actions and sizes
    f.entropy("ae", "x", "kind", by="chunk_id, street", kind="plain", where=f"mine AND street IN {STREETS}")
    f.step("aes", "SELECT chunk_id, avg(h) AS m, stddev_pop(h) AS s, " + ", ".join(f"max({at(s, 'h')}) AS h_{s}, max({at(s, 'total')}) AS n_{s}" for s in STREETS) + " FROM ae GROUP BY chunk_id")
    f.entropy("be", "x", d.rint(d.rint("amount / pot_before * 100") + " / 5"), by="chunk_id, street", kind="plain", where="mine AND agg AND pot_before > 0 AND amount > 0")
    f.step("bes", "SELECT chunk_id, " + ", ".join(f"max({at(s, 'h')}) AS h_{s}" for s in STREETS) + " FROM be GROUP BY chunk_id")
    # the others' first answer to hero's bets, while the street lasts
    f.step("is0", "SELECT chunk_id, hand_ix, act_ix, mine, agg, kind, CASE WHEN street = lag(street) OVER (PARTITION BY chunk_id, hand_ix ORDER BY act_ix) THEN 0 ELSE 1 END AS new FROM x")
    f.step("is1", "SELECT *, sum(new) OVER (PARTITION BY chunk_id, hand_ix ORDER BY act_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isle FROM is0")
    f.step("is2", "SELECT *, min(CASE WHEN NOT mine THEN act_ix END) OVER (PARTITION BY chunk_id, hand_ix, isle ORDER BY act_ix ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS reply FROM is1")
    f.step("vf", f"SELECT b.chunk_id, count(*) AS n, {share(is_a("fold", "r.kind"))} AS f, {share(is_a("call", "r.kind"))} AS c, {share('r.agg')} AS r FROM is2 b JOIN x0 r ON r.chunk_id = b.chunk_id AND r.hand_ix = b.hand_ix AND r.act_ix = b.reply WHERE b.mine AND b.agg GROUP BY b.chunk_id")

    total = lambda t, p, streets: "(" + " + ".join(f"coalesce({t}.{p}_{s}, 0)" for s in streets) + ")"
    af = lambda s: f"coalesce({div(f'af.a_{s}', f'af.c_{s}')}, 0)"
    post_af = f"coalesce({div(total('af', 'a', POST), total('af', 'c', POST))}, 0)"
    vs = "pres."
    c: dict[str, str] = {}
    for s in STREETS:
        c |= {f"bt_fold_to_{s}_aggression": div(f"fta.f_{s}", f"fta.n_{s}"), f"bt_faced_{s}_aggression_count": f"fta.n_{s}"}
    c |= {"bt_postflop_fold_to_aggression": div(total("fta", "f", POST), total("fta", "n", POST)), "bt_postflop_faced_aggression": total("fta", "n", POST)}
    c |= {f"bt_hero_af_{s}": af(s) for s in STREETS} | {"bt_hero_af_postflop": post_af, "bt_hero_af_mismatch": f"{af('preflop')} - {post_af}", "bt_hero_af_ratio": f"{af('preflop')} / greatest({post_af}, 0.01)"}
    c |= {"bt_hero_vpip": vs + "vpip", "bt_hero_3bet_rate": vs + "three", "bt_hero_open_raise_rate": vs + "opened", "bt_hero_3bet_vpip_ratio": "pres.three / greatest(pres.vpip, 0.01)", "bt_hero_3bet_open_ratio": "pres.three / greatest(pres.opened, 0.01)"}
    c |= {"bt_wwsf_proxy": div("fl.won", "fl.saw"), "bt_saw_flop_count": "fl.saw", "bt_cbet_fold_rate": div("fl.gave", "fl.chances"), "bt_cbet_opportunities": "fl.chances", "bt_check_fold_flop_rate": div("fl.check_fold", "fl.checked")}
    for s in STREETS:
        c |= {f"bt_hero_{s}_bet_ratio_std": f"sz.s_{s}", f"bt_hero_{s}_bet_ratio_mean": f"sz.m_{s}", f"bt_hero_{s}_snap_rate": f"sz.n_{s}"}
    c |= {"bt_hero_overall_bet_ratio_std": "sz.s", "bt_hero_overall_snap_rate": "sz.snap", "bt_hero_unique_raise_to": "rt.u", "bt_hero_raise_to_count": "rt.n", "bt_hero_raise_to_uniqueness": div("rt.u", "rt.n")}
    c |= {f"bt_hero_agg_rate_{s}": f"tr.q_{s}" for s in STREETS}
    third = "((tr.q_flop + tr.q_turn + tr.q_river) / 3)"
    squares = " + ".join(f"(tr.q_{s} - {third}) * (tr.q_{s} - {third})" for s in POST)
    c |= {"bt_preflop_to_postflop_agg_drop": f"greatest(0.0, tr.q_preflop - {third})", "bt_agg_trend_flop_to_river": "tr.q_flop - tr.q_river", "bt_postflop_agg_consistency": f"CASE WHEN tr.q_flop <> 0 AND tr.q_turn <> 0 AND tr.q_river <> 0 THEN sqrt(({squares}) / 3) END"}
    move = {"vpip": "dr_h.vpip", "pfr": "dr_h.pfr", "agg": "dr_a.agg", "fold": "dr_a.fold", "bet_size": "dr_a.size"}
    step = {k: f"(coalesce({v}_1, 0) - coalesce({v}_0, 0))" for k, v in move.items()}
    c |= {f"gto_drift_{k}": f"abs({v})" for k, v in step.items()} | {"gto_drift_composite": "(" + " + ".join(f"abs({v})" for v in step.values()) + ") / 5", "gto_drift_vpip_signed": step["vpip"], "gto_drift_agg_signed": step["agg"]}
    for s in POST:
        c |= {f"gto_bet_rate_{s}": f"cb.r_{s}", f"gto_bet_imbalance_{s}": f"abs(coalesce(cb.r_{s}, 0) - 0.5)", f"gto_bet_rate_std_{s}": f"cb.s_{s}", f"gto_bet_rate_cv_{s}": f"cb.s_{s} / greatest(abs(coalesce(cb.m_{s}, 0)), 1e-9)"}
        c |= {f"gto_probe_rate_{s}": f"pbs.p_{s}", f"gto_raise_vs_bet_rate_{s}": f"pbs.r_{s}", f"gto_checked_to_count_{s}": f"pbs.n_{s}", f"gto_probe_rate_std_{s}": f"pbs.s_{s}"}
    c |= {"gto_vpip_mean": "pres.vpip", "gto_pfr_mean": "pres.pfr", "gto_3bet_mean": "pres.three", "gto_pfr_vpip_ratio": "pres.pfr / greatest(pres.vpip, 1e-9)", "gto_vpip_std": "pres.vpip_s", "gto_pfr_std": "pres.pfr_s", "gto_pfr_vpip_ratio_std": "pres.ratio_s", "gto_3bet_std": "pres.three_s", "gto_vpip_cv": "pres.vpip_s / greatest(pres.vpip, 1e-9)", "gto_pfr_cv": "pres.pfr_s / greatest(pres.pfr, 1e-9)"}
    for s in STREETS:
        c |= {f"gto_response_entropy_{s}": f"rs_e.h_{s}", f"gto_response_count_{s}": f"rs_n.n_{s}", f"gto_fold_rate_vs_bet_{s}": f"rs_n.f_{s}", f"gto_call_rate_vs_bet_{s}": f"rs_n.c_{s}", f"gto_raise_rate_vs_bet_{s}": f"rs_n.r_{s}", f"gto_response_pot_sensitivity_{s}": f"rs_d.d_{s}"}
    c |= {"gto_postflop_response_entropy": "rs_post.h"}
    c |= {"at_hero_4bet_rate": div("rws.h4", "greatest(rws.f3, 1)"), "at_hero_5bet_rate": div("rws.h5", "greatest(rws.f4, 1)"), "at_hero_4bet_count": "rws.h4", "at_hero_5bet_count": "rws.h5", "at_3bet_faced_count": "rws.f3", "at_4bet_faced_count": "rws.f4", "at_hero_4bet_per_hand": div("rws.h4", "hero.n_hands"), "at_hero_5bet_per_hand": div("rws.h5", "hero.n_hands")}
    for b in BUCKETS:
        c |= {f"at_hero_agg_{b}": f"sprs.q_{b}", f"at_hero_{b}_hand_count": f"sprs.n_{b}"}
    c |= {"at_spr_agg_variance": "sprs.s", "at_spr_agg_range": "sprs.r"}
    hu, mw = f"coalesce({div('mw.hb', 'mw.hn')}, 0)", f"coalesce({div('mw.mb', 'mw.mn')}, 0)"
    c |= {"at_hero_hu_postflop_agg": hu, "at_hero_mw_postflop_agg": mw, "at_hero_hu_mw_agg_diff": f"{hu} - {mw}", "at_hero_hu_hands": "mw.hn", "at_hero_mw_hands": "mw.mn", "at_hero_mw_ratio": div("mw.mn", "greatest(mw.hn + mw.mn, 1)")}
    for s in STREETS:
        c |= {f"at_hero_action_entropy_{s}": f"aes.h_{s}", f"at_hero_action_count_{s}": f"aes.n_{s}", f"at_hero_bet_size_entropy_{s}": f"bes.h_{s}"}
    c |= {"at_hero_action_entropy_mean": "aes.m", "at_hero_action_entropy_std": "aes.s"}
    c |= {"at_villain_fold_to_hero_bet": "vf.f", "at_villain_call_to_hero_bet": "vf.c", "at_villain_raise_to_hero_bet": "vf.r", "at_hero_bets_faced_by_villain": "vf.n"}
    i, o = f"coalesce({div('ip.ib', 'ip.n_in')}, 0)", f"coalesce({div('ip.ob', 'ip.n_out')}, 0)"
    c |= {"at_hero_ip_postflop_agg": i, "at_hero_oop_postflop_agg": o, "at_hero_ip_oop_agg_diff": f"{i} - {o}", "at_hero_ip_hands": "ip.n_in", "at_hero_oop_hands": "ip.n_out", "at_hero_ip_ratio": div("ip.n_in", "greatest(ip.n_in + ip.n_out, 1)")}
    c |= {"at_preflop_2bet_rate": "dps.d1", "at_preflop_3bet_rate": "dps.d2", "at_preflop_4bet_rate": "dps.d3", "at_preflop_5bet_plus_rate": "dps.d4", "at_preflop_max_depth": "dps.top", "at_preflop_depth_entropy": "dp_h.h"}
    for k in DEPTHS:
        c |= {f"at_hero_action_entropy_at_{k}bet": f"das.h_{k}", f"at_hero_count_at_{k}bet": f"das.n_{k}"}
    parts = ["fta", "af", "pres", "fl", "sz", "rt", "tr", "cb", "dr_h", "dr_a", "pbs", "rs_e", "rs_d", "rs_n", "rs_post", "rws", "dps", "dp_h", "das", "sprs", "mw", "ip", "aes", "bes", "vf"]
    f.last = joined("hero", parts, {n: f"coalesce(CAST({e} AS DOUBLE), CAST(0 AS DOUBLE))" for n, e in c.items()}, digits=digits, only=only)
    return f
