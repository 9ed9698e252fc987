"""Forty features of a hand, seven statistics of each over a chunk, and repeated sequences: 293 features."""

from __future__ import annotations

from quillon.functions.sql import BLIND, Dialect, Flow, count_if, div, joined, quantile, share

STATS = ("mean", "std", "min", "max", "q10", "q50", "q90")
#: Big blind to which pots and stacks are scaled.
BB = 0.02
# Upper ends of the size classes of a sequence of amounts.
SIZES = ((0.0, "z"), (0.5, "xs"), (1.0, "s"), (2.0, "m"), (5.0, "l"))


def flow(d: Dialect, digits: int | None = None, only: tuple[str, ...] = ()) -> Flow:
    f = Flow()
    by = "chunk_id, hand_ix"
    f.step("a", f"SELECT {by}, act_ix, lower(trim(coalesce(street, ''))) AS street, coalesce(seat, 0) AS seat, kind, raise_to, call_to, greatest(0.0, amt_bb) AS v, greatest(0.0, pot_before / {BB}) AS pb, greatest(0.0, pot_after / {BB}) AS pa FROM act")
    f.step("l", f"SELECT *, lag(pa) OVER (PARTITION BY {by} ORDER BY act_ix) AS pa0 FROM a")
    f.step("sw", f"SELECT {by}, {count_if('seat <> s0')} AS switches, count(*) AS n FROM (SELECT *, lag(seat) OVER (PARTITION BY {by} ORDER BY act_ix) AS s0 FROM a WHERE seat > 0) x GROUP BY {by}")
    for name, col, cond in (("seat", "seat", "seat > 0"), ("kind", "kind", "TRUE")):  # longest runs: gaps and islands
        f.step(f"i_{name}", f"SELECT {by}, act_ix, CASE WHEN {col} = lag({col}) OVER (PARTITION BY {by} ORDER BY act_ix) THEN 0 ELSE 1 END AS s FROM a WHERE {cond}")
        f.step(f"j_{name}", f"SELECT {by}, sum(s) OVER (PARTITION BY {by} ORDER BY act_ix ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM i_{name}")
        f.step(f"k_{name}", f"SELECT {by}, g, count(*) AS c FROM j_{name} GROUP BY {by}, g")
        f.step(f"run_{name}", f"SELECT {by}, CAST(max(c) AS DOUBLE) / sum(c) AS q FROM k_{name} GROUP BY {by}")
    f.entropy("h_kind", "a", "kind", by=by, kind="even")
    f.entropy("h_seat", "a", "seat", by=by, kind="even", where="seat > 0")
    f.entropy("h_street", "a", "street", by=by, kind="even")
    kinds = ", ".join(f"{count_if(f'kind = {k!r}')} AS n_{k}" for k in ("call", "check", "fold", "bet", "raise", "all_in"))
    f.step(
        "g",
        f"""SELECT {by}, count(*) AS n, {kinds}, {count_if(f'kind IN {BLIND}')} AS n_blind, {count_if("street = 'preflop'")} AS pre, {count_if("street NOT IN ('', 'preflop')")} AS post,
        count(DISTINCT CASE WHEN seat > 0 THEN seat END) AS seats, avg(v) AS v_mean, stddev_pop(v) AS v_std, {quantile('v', 0.9)} AS v_90, max(v) AS v_max, {count_if('v > 0')} AS nonzero,
        avg(pb) AS pb, avg(pa) AS pa, avg(greatest(0.0, pa - pb)) AS pd, max(pa) - min(pb) AS growth, {count_if('pa + 1e-9 >= pa0')} AS mono, count(raise_to) AS rt, count(call_to) AS ct FROM l GROUP BY {by}""",
    )
    f.step("own", f"SELECT a.chunk_id, a.hand_ix, {count_if('a.seat = h.hero_seat AND h.hero_seat > 0')} AS hero, {count_if('a.seat = h.button_seat AND h.button_seat > 0')} AS button FROM a JOIN hand h ON h.chunk_id = a.chunk_id AND h.hand_ix = a.hand_ix WHERE a.seat > 0 GROUP BY a.chunk_id, a.hand_ix")
    f.step("stk", f"SELECT {by}, avg(x) AS m, stddev_pop(x) AS s, {quantile('x', 0.75)} - {quantile('x', 0.25)} AS iqr FROM (SELECT {by}, coalesce(stack, 0.0) / {BB} AS x FROM play) p GROUP BY {by}")
    n1 = "greatest(coalesce(g.n, 0), 1)"
    known = "greatest(g.n_call + g.n_check + g.n_bet + g.n_raise + g.n_fold, 1)"
    per = {
        "player_count": "h.n_players", "seat_utilization": div("h.n_players", "h.max_seats"), "action_count": "g.n", "street_count": "h.n_streets",
        **{f"{k}_share": div(f"g.n_{k}", known) for k in ("call", "check", "fold", "bet", "raise")},
        "blind_share": div("g.n_blind", n1), "allin_share": div("g.n_all_in", n1), "aggression_share": div("g.n_bet + g.n_raise", n1), "passive_share": div("g.n_call + g.n_check", n1),
        "preflop_share": div("g.pre", n1), "postflop_share": div("g.post", n1), "action_entropy": "h_kind.h", "actor_entropy": "h_seat.h", "street_entropy": "h_street.h",
        "unique_actor_share": div("g.seats", "greatest(h.n_players, 1)"), "actor_switch_rate": div("sw.switches", "greatest(sw.n - 1, 1)"), "actor_run_max_share": "run_seat.q", "action_run_max_share": "run_kind.q",
        "amount_mean_bb": "g.v_mean", "amount_std_bb": "g.v_std", "amount_q90_bb": "g.v_90", "amount_max_bb": "g.v_max", "nonzero_amount_share": div("g.nonzero", n1),
        "pot_before_mean_bb": "g.pb", "pot_after_mean_bb": "g.pa", "pot_delta_mean_bb": "g.pd", "pot_growth_bb": "g.growth", "pot_monotonic_rate": div("g.mono", "greatest(g.n - 1, 1)"),
        "raise_to_share": div("g.rt", n1), "call_to_share": div("g.ct", n1), "starting_stack_mean_bb": "stk.m", "starting_stack_std_bb": "stk.s", "starting_stack_iqr_bb": "stk.iqr",
        "hero_action_share": div("own.hero", n1), "button_action_share": div("own.button", n1), "hero_button_same": "CASE WHEN h.hero_seat > 0 AND h.hero_seat = h.button_seat THEN 1 ELSE 0 END",
    }
    parts = ["g", "h_kind", "h_seat", "h_street", "sw", "run_seat", "run_kind", "own", "stk"]
    joins = " ".join(f"LEFT JOIN {p} ON {p}.chunk_id = h.chunk_id AND {p}.hand_ix = h.hand_ix" for p in parts)
    f.step("ph", "SELECT h.chunk_id, h.hand_ix, " + ", ".join(f"coalesce(CAST({e} AS DOUBLE), CAST(0 AS DOUBLE)) AS {n}" for n, e in per.items()) + f" FROM hand h {joins}", keep=True)
    size = "CASE " + " ".join(f"WHEN v <= {top} THEN '{name}'" for top, name in SIZES) + " ELSE 'xl' END"
    f.step("sig", f"SELECT {by}, {d.sequence_key('kind', 'act_ix')} AS action, {d.sequence_key('street', 'act_ix')} AS street, {d.sequence_key(size, 'act_ix')} AS amount_bucket FROM a GROUP BY {by}")
    f.step("sig_s", f"SELECT {by}, {d.sequence_key('seat', 'act_ix')} AS actor FROM a WHERE seat > 0 GROUP BY {by}")
    f.step("sigs", "SELECT h.chunk_id, coalesce(s.action, '') AS action, coalesce(t.actor, '') AS actor, coalesce(s.street, '') AS street, coalesce(s.amount_bucket, '') AS amount_bucket FROM hand h LEFT JOIN sig s ON s.chunk_id = h.chunk_id AND s.hand_ix = h.hand_ix LEFT JOIN sig_s t ON t.chunk_id = h.chunk_id AND t.hand_ix = h.hand_ix", keep=True)
    signs = ("action", "actor", "street", "amount_bucket")
    for s in signs:
        f.entropy(f"sig_{s}", "sigs", s)
    stat = {"mean": "avg({0})", "std": "stddev_pop({0})", "min": "min({0})", "max": "max({0})"}
    cells = [(f"{n}_{s}", stat[s].format(n) if s in stat else quantile(n, int(s[1:]) / 100)) for n in per for s in STATS]
    half = len(cells) // 4 + 1
    tables = [f"agg{i}" for i in range(0, 4)]
    for i, t in enumerate(tables):  # in four steps: one aggregate of this width is too wide for generated code
        f.step(t, "SELECT chunk_id, " + ", ".join(f"{e} AS {n}" for n, e in cells[i * half : (i + 1) * half]) + " FROM ph GROUP BY chunk_id")
    f.step("rates", f"SELECT chunk_id, count(*) AS n, {share('aggression_share >= 0.35')} AS ha, {share('action_entropy <= 0.35')} AS le, {share('actor_entropy >= 0.75')} AS he, {share('action_count >= 12')} AS la FROM ph GROUP BY chunk_id")
    columns = {"hand_count": "rates.n"} | {f"schema_{n}": f"agg{i // half}.{n}" for i, (n, _) in enumerate(cells)}
    for s in signs:
        columns |= {f"schema_{s}_signature_top_share": f"sig_{s}.top", f"schema_{s}_signature_unique_share": div(f"sig_{s}.kinds", f"sig_{s}.total")}
    columns |= {"schema_high_aggression_hand_rate": "rates.ha", "schema_low_action_entropy_hand_rate": "rates.le", "schema_high_actor_entropy_hand_rate": "rates.he", "schema_long_action_hand_rate": "rates.la"}
    f.last = joined("rates", [*tables, *(f"sig_{s}" for s in signs)], columns, digits=digits, only=only)
    return f
