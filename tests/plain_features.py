"""Features of a chunk of hands in plain Python, written from their definitions and apart from the library's SQL.

A chunk is a list of hands as nested documents; undefined values are None.
"""

import math
from collections import Counter, defaultdict
from itertools import groupby, pairwise

import numpy as np

BLINDS = ("small_blind", "big_blind", "ante")
BETS = ("bet", "raise", "all_in")
RAISES = ("raise", "all_in")
IN = ("call", "bet", "raise", "all_in")
STREETS = ("preflop", "flop", "turn", "river")


def mean(x):
    x = list(x)
    return float(np.mean(x)) if x else None


def std(x):
    x = list(x)
    return float(np.std(x)) if x else None


def spread(x):
    """Coefficient of variation, of two values or more."""
    x = list(x)
    return float(np.std(x) / np.mean(x)) if len(x) > 1 and np.mean(x) != 0 else None


def bits(counts):
    n = sum(counts)
    return -sum(c / n * math.log2(c / n + 1e-12) for c in counts) if n else None


def share(flags):
    flags = list(flags)
    return sum(flags) / len(flags) if flags else None


def at(x, q):
    return float(np.quantile(x, q)) if len(x) else None


def ratio(a, b):
    return a / b if b else None


def kept(x):
    return [v for v in x if v is not None]


def acts(hand, *kinds, street=None, blinds=False):
    """Actions of a hand in order; of some kinds, of a street."""
    return [a for a in hand["actions"] if (blinds or a["action_type"] not in BLINDS) and (not kinds or a["action_type"] in kinds) and (street is None or a["street"] == street)]


def vpip_of(hand):
    """By seat (not 0) that acted before the flop: whether it put money in."""
    seats = {p["seat"] for p in hand["players"] if p["seat"]}
    own = {s: [a for a in acts(hand, street="preflop") if a["actor_seat"] == s] for s in seats}
    return {s: int(any(a["action_type"] in IN for a in x)) for s, x in own.items() if x}


def actions_set(chunk):
    n, flat = len(chunk), [a for h in chunk for a in acts(h)]
    kind = Counter(a["action_type"] for a in flat)
    m = max(1, len(flat))
    bets = [a | {"v": a["normalized_amount_bb"], "p": a["amount"] / a["pot_before"] if a["pot_before"] > 0 else None} for a in flat if a["action_type"] in ("bet", "raise") and a["normalized_amount_bb"] > 0]
    v, pct = [b["v"] for b in bets], kept(b["p"] for b in bets)
    whole = [abs(x - round(x)) for x in v]
    near = lambda x: share(abs(y - round(y)) < 0.15 for y in x)
    tenths = Counter(round(x / 0.1) for x in pct)
    top = [c for _, c in tenths.most_common(3)]
    by_seat = defaultdict(list)
    for b in bets:
        if b["actor_seat"]:
            by_seat[b["actor_seat"]].append(b)
    seat_v = [x for x in ([b["v"] for b in s] for s in by_seat.values()) if len(x) > 2]
    seat_p = [x for x in (kept(b["p"] for b in s) for s in by_seat.values()) if len(x) > 2]
    styles = defaultdict(lambda: defaultdict(list))
    for h in chunk:
        for s in {p["seat"] for p in h["players"]}:
            own = [a for a in h["actions"] if a["actor_seat"] == s]
            pre = [a["action_type"] for a in own if a["street"] == "preflop" and a["action_type"] not in BLINDS]
            styles["vpip"][s].append(any(k in IN for k in pre))
            styles["pfr"][s].append(any(k in RAISES for k in pre))
            styles["fold"][s].append(any(a["action_type"] == "fold" for a in own))
    step = max(5, n // 8)
    parts = [p for p in (chunk[i : i + step] for i in range(0, n, step)) if len(p) > 2]
    folds = [sum(a["action_type"] == "fold" for h in p for a in acts(h)) / max(1, sum(len(acts(h, "call", "check", "bet", "raise", "fold", "all_in")) for h in p)) for p in parts]
    vpips = kept(mean(x for h in p for x in vpip_of(h).values()) for p in parts)
    street = {s: share(a["action_type"] in BETS for a in flat if a["street"] == s) for s in STREETS}
    size = {s: mean(b["v"] for b in bets if b["street"] == s) for s in STREETS}
    raises = [len(acts(h, *RAISES, street="preflop")) for h in chunk]
    limps = chances = cbets = check_raises = 0
    for h in chunk:
        first = [a["action_type"] for a in acts(h, "call", *RAISES, street="preflop")][:1]
        limps += first == ["call"]
        raisers, flop = acts(h, *RAISES, street="preflop"), [a for a in h["actions"] if a["street"] == "flop"]
        if raisers and flop:
            chances += 1
            opened = [a for a in flop if a["action_type"] != "check"][:1]
            cbets += any(a["action_type"] in BETS and a["actor_seat"] == raisers[-1]["actor_seat"] for a in opened)
        for s in STREETS[1:]:
            for seat in {a["actor_seat"] for a in h["actions"] if a["actor_seat"]}:
                seq = "".join(a["action_type"][0] if a["action_type"] != "all_in" else "r" for a in h["actions"] if a["street"] == s and a["actor_seat"] == seat and a["action_type"] in ("check", "raise", "all_in"))
                check_raises += "c" in seq and "r" in seq[seq.index("c") :]
    out = {"n_hands": n, "fold_rate": kind["fold"] / m, "call_rate": kind["call"] / m, "check_rate": kind["check"] / m, "raise_rate": sum(kind[k] for k in BETS) / m, "allin_rate": kind["all_in"] / m}
    out |= {"avg_streets": mean(len(h["streets"]) for h in chunk), "avg_players": mean(len(h["players"]) for h in chunk), "preflop_only_rate": share(not h["streets"] for h in chunk), "river_rate": share(len(h["streets"]) > 2 for h in chunk)}
    out |= {"bet_mean_bb": mean(v), "bet_std_bb": std(v), "bet_cv": spread(v), "bet_entropy": bits(tenths.values()), "n_distinct_pot_pcts": len(tenths) or None, "pot_pct_mean": mean(pct), "pot_pct_std": std(pct), "pot_pct_cv": spread(pct)}
    for name, of in styles.items():
        means = [np.mean(x) for x in of.values()]
        out |= {f"{name}_mean": mean(means), f"{name}_std": std(means)}
    out |= {"fold_cv_time": spread(folds), "vpip_cv_time": spread(vpips)}
    out |= {"bet_mode_concentration": ratio(sum(top[:1]), len(pct)), "bet_top3_concentration": ratio(sum(top), len(pct)), "round_frac_rate": share(min(abs(x - f) for f in (0.25, 0.33, 0.5, 0.66, 0.75, 1.0)) < 0.04 for x in pct)}
    out |= {"pot_pct_p10": at(pct, 0.1), "pot_pct_p90": at(pct, 0.9), "pot_pct_p90_p10": at(pct, 0.9) - at(pct, 0.1) if pct else None}
    cvs, means = kept(map(spread, seat_p)), [np.mean(x) for x in seat_p]
    out |= {"seat_betsize_cv_mean": mean(cvs), "seat_betsize_cv_min": min(cvs, default=None), "seat_pot_pct_range": float(np.ptp(means)) if len(means) > 1 else None, "seat_pot_pct_std_of_mean": std(means) if len(means) > 1 else None}
    out |= {f"agg_freq_{s}": x for s, x in street.items()} | {"agg_freq_street_cv": spread(kept(street.values()))}
    out |= {"threebet_rate": share(r > 1 for r in raises), "fourbet_rate": share(r > 2 for r in raises), "limp_rate": limps / n, "cbet_rate": ratio(cbets, chances), "checkraise_per_hand": check_raises / n, "showdown_rate": share(h["outcome"]["showdown"] for h in chunk)}
    out |= {"actions_per_hand_mean": mean(len(acts(h)) for h in chunk), "actions_per_hand_std": std(len(acts(h)) for h in chunk)}
    out |= {f"bet_mean_bb_{s}": x for s, x in size.items()} | {"bet_mean_bb_street_cv": spread(kept(size.values()))}
    out |= {"bet_median_bb": at(v, 0.5), "bet_p10_bb": at(v, 0.1), "bet_p90_bb": at(v, 0.9), "bet_iqr_bb": at(v, 0.75) - at(v, 0.25) if v else None, "bet_max_bb": max(v, default=None), "bet_bb_entropy": bits(Counter(map(round, v)).values())}
    out |= {"near_integer_bb_rate": near(v), "common_bb_rate": share(any(abs(x - t) < 0.3 for t in (2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 7.5, 10.0, 15.0, 20.0, 25.0)) for x in v), "mean_distance_to_int_bb": mean(whole), "median_distance_to_int_bb": at(whole, 0.5)}
    out |= {"near_half_bb_rate": share(abs(x - round(2 * x) / 2) < 0.1 for x in v), "bet_decimal_entropy": bits(Counter(round(math.modf(x)[0] / 0.1) for x in v).values())}
    out |= {"near_integer_bb_rate_preflop": near(b["v"] for b in bets if b["street"] == "preflop"), "near_integer_bb_rate_postflop": near(b["v"] for b in bets if b["street"] in STREETS[1:])}
    nears, means, cvs = list(map(near, seat_v)), [np.mean(x) for x in seat_v], kept(map(spread, seat_v))
    out |= {"seat_near_integer_bb_min": min(nears, default=None), "seat_near_integer_bb_max": max(nears, default=None), "seat_near_integer_bb_range": max(nears) - min(nears) if nears else None}
    out |= {"seat_bet_mean_bb_range": float(np.ptp(means)) if len(means) > 1 else None, "seat_bet_mean_bb_std_of_mean": std(means) if len(means) > 1 else None, "seat_bet_bb_cv_mean": mean(cvs), "seat_bet_bb_cv_min": min(cvs, default=None)}
    return out


def lag1(x):
    x = np.array(x)
    return float(np.corrcoef(x[:-1], x[1:])[0, 1]) if len(x) > 4 and np.std(x[:-1]) > 0 and np.std(x[1:]) > 0 else None


def temporal_set(chunk):
    stacks = defaultdict(list)
    for i, h in enumerate(chunk):
        for p in h["players"]:
            if p["seat"] is not None and p["starting_stack"] is not None:
                stacks[p["seat"]].append((i, p["starting_stack"]))
    every = [s for x in stacks.values() for _, s in x]
    cap = max(every, default=None)
    moves = [(a, b) for x in stacks.values() for (i, a), (j, b) in pairwise(x) if j == i + 1]
    out = {"stack_at_cap_rate": share(abs(s - cap) < 1e-9 for s in every), "stack_unique_ratio": ratio(len(set(every)), len(every)), "stack_delta_abs_mean": mean(abs(b - a) for a, b in moves), "stack_delta_std": std(b - a for a, b in moves)}
    out |= {"stack_delta_zero_rate": share(abs(b - a) < 1e-9 for a, b in moves), "stack_topup_rate": share(abs(b - cap) < 1e-9 and a < cap - 1e-9 for a, b in moves), "stack_gain_rate": share(b - a > 1e-9 for a, b in moves)}
    runs = [[a["action_type"] for a in acts(h, street=s)] for h in chunk for s in {a["street"] for a in h["actions"]} if s]
    one, two = Counter(k for r in runs for k in r), Counter(p for r in runs for p in pairwise(r))
    n, before = sum(two.values()), Counter()
    for (a, _), c in two.items():
        before[a] += c
    out |= {"action_unigram_entropy": bits(one.values()), "action_bigram_entropy": bits(two.values()), "action_repeat_rate": ratio(sum(c for (a, b), c in two.items() if a == b), n), "bigram_top1_share": ratio(sum(sorted(two.values())[-1:]), n), "bigram_top3_share": ratio(sum(sorted(two.values())[-3:]), n)}
    out["action_cond_entropy"] = -sum(c / n * math.log2(c / before[a] + 1e-12) for (a, _), c in two.items()) if n else None
    place = defaultdict(list)
    for h in chunk:
        for k, a in enumerate(acts(h, street="preflop")[:6]):
            place[k].append(a["action_type"])
    fold = {k: x.count("fold") / len(x) for k, x in place.items()}
    long = sorted(k for k, x in place.items() if len(x) >= 10)
    out |= {"fold_rate_first_to_act": fold.get(0), "first_action_fold_share": fold.get(0), "raise_rate_first_to_act": share(k in RAISES for k in place[0]), "fold_pos_slope": float(np.polyfit(long, [fold[k] for k in long], 1)[0]) if len(long) > 2 else None}
    agg = [share(a["action_type"] in BETS for a in acts(h)) for h in chunk if acts(h)]
    seen = [vpip_of(h) for h in chunk]
    half = len(agg) // 2
    out |= {"agg_lag1_autocorr": lag1(agg), "vpip_lag1_autocorr": lag1([np.mean(list(s.values())) for s in seen if s]), "agg_halves_absdiff": abs(np.mean(agg[:half]) - np.mean(agg[half:])) if len(agg) > 9 else None}
    zs, disp = [], []
    for seat in {s for x in seen for s in x}:
        x = [s[seat] for s in seen if seat in s]
        n1, n0, p = sum(x), len(x) - sum(x), np.mean(x)
        if len(x) >= 12 and n1 > 2 and n0 > 2:
            e = 2 * n1 * n0
            var = e * (e - len(x)) / (len(x) ** 2 * (len(x) - 1))
            zs += [(len(list(groupby(x))) - e / len(x) - 1) / math.sqrt(var)] if var > 0 else []
        if len(x) >= 30 and 0.05 < p < 0.95:
            disp.append(np.var([np.mean(x[i : i + 10]) for i in range(0, len(x) - 9, 10)]) / (p * (1 - p) / 10))
    out |= {"vpip_runs_z_mean": mean(zs), "vpip_runs_absz_mean": mean(map(abs, zs)), "vpip_dispersion_ratio": mean(disp)}
    again, flops, capped = [], [], []
    for h in chunk:
        to = [a["raise_to"] for a in acts(h, *RAISES, street="preflop") if a["raise_to"]]
        again += [b / a for a, b in pairwise(to) if a > 0]
        capped += [cap is not None and a["raise_to"] >= 0.93 * cap for a in h["actions"] if a["raise_to"]]
        bet = [a["amount"] for a in acts(h, *BETS, street="flop")][:1]
        flops += [bet[0] / to[-1]] if to and bet and bet[0] > 0 and to[-1] > 0 else []
    out |= {"reraise_ratio_mean": mean(again), "reraise_ratio_std": std(again), "reraise_ratio_cv": spread(again), "flop_vs_pf_ratio_mean": mean(flops), "flop_vs_pf_ratio_cv": spread(flops), "near_cap_raise_rate": share(capped)}
    sizes = [len(h["players"]) for h in chunk]
    sets = [{p["seat"] for p in h["players"] if p["seat"]} for h in chunk]
    like = [len(a & b) / len(a | b) for a, b in pairwise(sets) if a | b]
    out |= {"frac_headsup": share(s == 2 for s in sizes), "frac_fullring": share(s >= 5 for s in sizes), "table_size_change_rate": share(a != b for a, b in pairwise(sizes)), "seat_jaccard_mean": mean(like), "seat_jaccard_min": min(like, default=None)}
    heroes = Counter(h["metadata"]["hero_seat"] for h in chunk if h["metadata"]["hero_seat"] is not None)
    lengths = [len(acts(h)) for h in chunk]
    out |= {"hero_seat_entropy": bits(heroes.values()), "hero_seat_mode_share": ratio(max(heroes.values(), default=0), sum(heroes.values())), "walk_rate": share(not acts(h, *IN) for h in chunk), "hand_len_entropy": bits(Counter(lengths).values()), "one_action_hand_rate": share(x < 2 for x in lengths)}
    return out


def context_set(chunk):
    spots, curve, kinds = defaultdict(Counter), defaultdict(list), Counter()
    by_street, fractions, crowd = defaultdict(list), [], {True: [], False: []}
    for h in chunk:
        bet_on, few = set(), len({a["actor_seat"] for a in acts(h)}) <= 2
        for a in acts(h):
            spots[(a["street"], min(6, len(h["players"])), a["street"] in bet_on)][a["action_type"]] += 1
            if a["action_type"] in BETS:
                bet_on.add(a["street"])
            kinds[a["action_type"]] += 1
            by_street[a["street"]].append(a["action_type"] in BETS)
            crowd[few].append(a["action_type"] == "fold")
            if a["action_type"] in ("bet", "raise") and a["amount"] and a["pot_before"] > 0 and 0 < a["amount"] / a["pot_before"] < 5:
                fractions.append(a["amount"] / a["pot_before"])
        for k, a in enumerate(acts(h, street="preflop")[:6]):
            curve[k].append(a["action_type"])
    often = [c for c in spots.values() if c.total() >= 5]
    h, d = [bits(c.values()) for c in often], [max(c.values()) / c.total() for c in often]
    out = {"gto_ctx_entropy_mean": mean(h), "gto_ctx_entropy_std": std(h), "gto_ctx_dominance_mean": mean(d), "gto_ctx_dominance_std": std(d), "gto_n_contexts": len(spots)}
    for name, own in (("agg", RAISES), ("vpip", IN)):
        y = [share(k in own for k in curve[i]) for i in sorted(curve) if len(curve[i]) >= 8]
        step = np.sign(np.diff(y)).tolist()
        out |= {f"pos_{name}_monotonicity": max(step.count(1), step.count(-1)) / len(step) if len(y) > 2 and any(step) else None, f"pos_{name}_range": max(y) - min(y) if len(y) > 1 else None}
        if name == "agg":
            out["pos_agg_roughness"] = std(np.diff(y, 2)) if len(y) > 2 else None
    dist = [min(abs(x - t) for t in (0.33, 0.5, 0.66, 0.75, 1.0)) for x in fractions]
    out |= {"potfrac_mean": mean(fractions), "potfrac_std": std(fractions), "potfrac_cv": std(fractions) / (mean(fractions) + 1e-9) if fractions else None, "potfrac_round_rate": share(x < 0.05 for x in dist), "potfrac_dist_to_round_mean": mean(dist)}
    out |= {"potfrac_n_unique": len({round(x * 100) for x in fractions}) or None, "potfrac_entropy": bits(Counter(round(x * 10) for x in fractions).values())}
    c = sorted(kinds.values())
    out |= {"action_type_entropy": bits(c), "action_type_gini": 2 * sum((i + 1) * x for i, x in enumerate(c)) / (len(c) * sum(c)) - (len(c) + 1) / len(c) if c else None}
    y = [share(by_street[s]) for s in STREETS if by_street[s]]
    out |= {"street_agg_slope": float(np.polyfit(range(len(y)), y, 1)[0]) if len(y) > 1 else None, "street_agg_dropoff": y[0] - y[-1] if len(y) > 1 else None}
    out["fold_hu_vs_mw_diff"] = share(crowd[True]) - share(crowd[False]) if min(map(len, crowd.values())) >= 10 else None
    return out


def even(values):
    """Natural entropy over that of as many equal kinds."""
    c = Counter(values)
    return -sum(x / c.total() * math.log(x / c.total() + 1e-12) for x in c.values()) / math.log(len(c)) if len(c) > 1 else 0.0


def run_share(x):
    return max(len(list(g)) for _, g in groupby(x)) / len(x) if x else 0.0


def one_hand(h):
    a, meta, n = h["actions"], h["metadata"], len(h["actions"])
    kinds, seats, streets = [x["action_type"] for x in a], [x["actor_seat"] for x in a if x["actor_seat"] > 0], [x["street"] for x in a]
    v, before, after = [max(0.0, x["normalized_amount_bb"]) for x in a], [max(0.0, x["pot_before"] / 0.02) for x in a], [max(0.0, x["pot_after"] / 0.02) for x in a]
    stacks, n1 = [(p["starting_stack"] or 0.0) / 0.02 for p in h["players"]], max(1, n)
    known = max(1, sum(map(kinds.count, ("call", "check", "bet", "raise", "fold"))))
    hero, button = meta["hero_seat"] or 0, meta["button_seat"] or 0
    zero = lambda x: 0.0 if x is None else x
    out = {"player_count": len(h["players"]), "seat_utilization": len(h["players"]) / max(1, meta["max_seats"]), "action_count": n, "street_count": len(h["streets"])}
    out |= {f"{k}_share": kinds.count(k) / known for k in ("call", "check", "fold", "bet", "raise")}
    out |= {"blind_share": sum(map(kinds.count, BLINDS)) / n1, "allin_share": kinds.count("all_in") / n1, "aggression_share": (kinds.count("bet") + kinds.count("raise")) / n1, "passive_share": (kinds.count("call") + kinds.count("check")) / n1}
    out |= {"preflop_share": streets.count("preflop") / n1, "postflop_share": sum(s not in ("", "preflop") for s in streets) / n1, "action_entropy": even(kinds), "actor_entropy": even(seats), "street_entropy": even(streets)}
    out |= {"unique_actor_share": len(set(seats)) / max(1, len(h["players"])), "actor_switch_rate": sum(x != y for x, y in pairwise(seats)) / max(1, len(seats) - 1), "actor_run_max_share": run_share(seats), "action_run_max_share": run_share(kinds)}
    out |= {"amount_mean_bb": zero(mean(v)), "amount_std_bb": zero(std(v)), "amount_q90_bb": zero(at(v, 0.9)), "amount_max_bb": max(v, default=0.0), "nonzero_amount_share": sum(x > 0 for x in v) / n1}
    out |= {"pot_before_mean_bb": zero(mean(before)), "pot_after_mean_bb": zero(mean(after)), "pot_delta_mean_bb": zero(mean(max(0.0, y - x) for x, y in zip(before, after, strict=True))), "pot_growth_bb": max(after) - min(before) if a else 0.0, "pot_monotonic_rate": sum(y + 1e-9 >= x for x, y in pairwise(after)) / max(1, n - 1)}
    out |= {"raise_to_share": sum(x["raise_to"] is not None for x in a) / n1, "call_to_share": sum(x["call_to"] is not None for x in a) / n1, "starting_stack_mean_bb": zero(mean(stacks)), "starting_stack_std_bb": zero(std(stacks)), "starting_stack_iqr_bb": at(stacks, 0.75) - at(stacks, 0.25) if stacks else 0.0}
    return out | {"hero_action_share": seats.count(hero) / n1 if hero > 0 else 0.0, "button_action_share": seats.count(button) / n1 if button > 0 else 0.0, "hero_button_same": float(hero > 0 and hero == button)}


def perhand_set(chunk):
    rows = [one_hand(h) for h in chunk]
    out = {"hand_count": len(chunk)}
    for name in rows[0]:
        x = [r[name] for r in rows]
        out |= {f"schema_{name}_{s}": f for s, f in (("mean", mean(x)), ("std", std(x)), ("min", min(x)), ("max", max(x)), ("q10", at(x, 0.1)), ("q50", at(x, 0.5)), ("q90", at(x, 0.9)))}
    size = lambda v: "z" if v <= 0 else "xs" if v <= 0.5 else "s" if v <= 1 else "m" if v <= 2 else "l" if v <= 5 else "xl"
    signs = {
        "action": [tuple(a["action_type"] for a in h["actions"]) for h in chunk],
        "actor": [tuple(a["actor_seat"] for a in h["actions"] if a["actor_seat"] > 0) for h in chunk],
        "street": [tuple(a["street"] for a in h["actions"]) for h in chunk],
        "amount_bucket": [tuple(size(a["normalized_amount_bb"]) for a in h["actions"]) for h in chunk],
    }
    for k, s in signs.items():
        out |= {f"schema_{k}_signature_top_share": max(Counter(s).values()) / len(s), f"schema_{k}_signature_unique_share": len(set(s)) / len(s)}
    out |= {"schema_high_aggression_hand_rate": share(r["aggression_share"] >= 0.35 for r in rows), "schema_low_action_entropy_hand_rate": share(r["action_entropy"] <= 0.35 for r in rows)}
    return out | {"schema_high_actor_entropy_hand_rate": share(r["actor_entropy"] >= 0.75 for r in rows), "schema_long_action_hand_rate": share(r["action_count"] >= 12 for r in rows)}


def plain_bits(values):
    c = Counter(values)
    return -sum(x / c.total() * math.log2(x / c.total()) for x in c.values()) if c else 0.0


def hero_set(chunk):
    """The hero is the hero seat of the first hand that names one; what is undefined is 0."""
    hero = next((h["metadata"]["hero_seat"] for h in chunk if h["metadata"]["hero_seat"] is not None), None)
    post, n = STREETS[1:], len(chunk)
    by = lambda h, s: [a for a in h["actions"] if a["street"] == s]
    mine = lambda a: a["actor_seat"] == hero
    bet = lambda a: a["action_type"] in BETS
    q = lambda a, b: a / b if b else 0.0
    z = lambda x: 0.0 if x is None else x
    out = {}
    # facing a bet; bets and calls
    faced, calls, hits = Counter(), Counter(), Counter()
    folds = Counter()
    for h in chunk:
        for s in STREETS:
            line = by(h, s)
            first = next((i for i, a in enumerate(line) if bet(a) and not mine(a)), len(line))
            answer = next((a["action_type"] for a in line[first:] if mine(a)), None)
            faced[s] += answer is not None
            folds[s] += answer == "fold"
            hits[s] += sum(mine(a) and bet(a) for a in line)
            calls[s] += sum(mine(a) and a["action_type"] == "call" for a in line)
    for s in STREETS:
        out |= {f"bt_fold_to_{s}_aggression": q(folds[s], faced[s]), f"bt_faced_{s}_aggression_count": faced[s], f"bt_hero_af_{s}": q(hits[s], calls[s])}
    total = lambda c: sum(c[s] for s in post)
    after = q(total(hits), total(calls))
    out |= {"bt_postflop_fold_to_aggression": q(total(folds), total(faced)), "bt_postflop_faced_aggression": total(faced), "bt_hero_af_postflop": after, "bt_hero_af_mismatch": out["bt_hero_af_preflop"] - after, "bt_hero_af_ratio": out["bt_hero_af_preflop"] / max(after, 0.01)}
    # hands before the flop
    vpip, pfr, three, opened = [], [], [], []
    for h in chunk:
        line = by(h, "preflop")
        others = next((i for i, a in enumerate(line) if not mine(a) and a["action_type"] in RAISES), len(line))
        raises = [i for i, a in enumerate(line) if mine(a) and a["action_type"] in RAISES]
        vpip.append(float(any(mine(a) and a["action_type"] in IN for a in line)))
        pfr.append(float(bool(raises)))
        three.append(float(any(i > others for i in raises)))
        opened.append(float(any(i < others for i in raises)))
    v, p, t, o = map(np.mean, (vpip, pfr, three, opened))
    out |= {"bt_hero_vpip": v, "bt_hero_3bet_rate": t, "bt_hero_open_raise_rate": o, "bt_hero_3bet_vpip_ratio": t / max(v, 0.01), "bt_hero_3bet_open_ratio": t / max(o, 0.01)}
    out |= {"gto_vpip_mean": v, "gto_pfr_mean": p, "gto_3bet_mean": t, "gto_pfr_vpip_ratio": p / max(v, 1e-9), "gto_vpip_std": np.std(vpip), "gto_pfr_std": np.std(pfr), "gto_3bet_std": np.std(three), "gto_vpip_cv": np.std(vpip) / max(v, 1e-9), "gto_pfr_cv": np.std(pfr) / max(p, 1e-9), "gto_pfr_vpip_ratio_std": z(std(b for a, b in zip(vpip, pfr, strict=True) if a))}
    # the flop
    flops = [(i, [a["action_type"] for a in by(h, "flop") if mine(a)]) for i, h in enumerate(chunk)]
    flops = [(i, k) for i, k in flops if k]
    raised = [k for i, k in flops if pfr[i]]
    checked = [k for _, k in flops if k[0] == "check"]
    out |= {"bt_saw_flop_count": len(flops), "bt_wwsf_proxy": q(sum(str(hero) in chunk[i]["outcome"]["winners"] for i, _ in flops), len(flops)), "bt_cbet_opportunities": len(raised), "bt_cbet_fold_rate": q(sum(k[0] in BETS and "fold" in k[1:] for k in raised), len(raised)), "bt_check_fold_flop_rate": q(sum("fold" in k[1:] for k in checked), len(checked))}
    # sizes
    own = [a for h in chunk for a in h["actions"] if mine(a)]
    sized = [(a["street"], a["amount"] / a["pot_before"]) for a in own if a["action_type"] in ("bet", "raise") and a["pot_before"] > 0 and a["amount"] > 0]
    snap = lambda x: any(abs(x - f) <= 0.05 * f for f in (0.25, 0.33, 0.5, 0.67, 0.75, 1.0, 1.25, 1.5, 2.0))
    for s in STREETS:
        x = [r for k, r in sized if k == s]
        out |= {f"bt_hero_{s}_bet_ratio_std": z(std(x)), f"bt_hero_{s}_bet_ratio_mean": z(mean(x)), f"bt_hero_{s}_snap_rate": z(share(map(snap, x)))}
    x, to = [r for _, r in sized], [round(a["raise_to"], 3) for a in own if bet(a) and a["raise_to"]]
    out |= {"bt_hero_overall_bet_ratio_std": z(std(x)), "bt_hero_overall_snap_rate": z(share(map(snap, x))), "bt_hero_unique_raise_to": len(set(to)), "bt_hero_raise_to_count": len(to), "bt_hero_raise_to_uniqueness": q(len(set(to)), len(to))}
    # shares of aggression by hand and street
    lines = {s: [[a for a in by(h, s) if mine(a)] for h in chunk] for s in STREETS}
    rate = {s: z(mean(share(map(bet, k)) for k in lines[s] if k)) for s in STREETS}
    out |= {f"bt_hero_agg_rate_{s}": r for s, r in rate.items()}
    late = [rate[s] for s in post]
    out |= {"bt_preflop_to_postflop_agg_drop": max(0.0, rate["preflop"] - np.mean(late)), "bt_agg_trend_flop_to_river": late[0] - late[2], "bt_postflop_agg_consistency": np.std(late) if all(late) else 0.0}
    for s in post:
        pairs = [(sum(map(bet, k)), sum(a["action_type"] == "check" for a in k)) for k in lines[s]]
        r, x = q(sum(b for b, _ in pairs), sum(b + c for b, c in pairs)), [b / (b + c) for b, c in pairs if b + c]
        out |= {f"gto_bet_rate_{s}": r, f"gto_bet_imbalance_{s}": abs(r - 0.5), f"gto_bet_rate_std_{s}": z(std(x)), f"gto_bet_rate_cv_{s}": z(std(x)) / max(abs(z(mean(x))), 1e-9)}
    # halves
    half = {}
    for side, hs, at0 in (("a", chunk[: n // 2], 0), ("b", chunk[n // 2 :], n // 2)):
        acts_ = [a for h in hs for a in h["actions"] if mine(a)]
        sizes = [a["amount"] / a["pot_before"] for a in acts_ if a["action_type"] in ("bet", "raise") and a["pot_before"] > 0 and a["amount"] > 0]
        half[side] = {"vpip": z(mean(vpip[at0 : at0 + len(hs)])), "pfr": z(mean(pfr[at0 : at0 + len(hs)])), "agg": z(share(map(bet, acts_))), "fold": z(share(a["action_type"] == "fold" for a in acts_)), "bet_size": z(mean(sizes))}
    move = {k: (half["b"][k] - half["a"][k]) if n >= 4 else 0.0 for k in half["a"]}
    out |= {f"gto_drift_{k}": abs(x) for k, x in move.items()} | {"gto_drift_composite": np.mean(list(map(abs, move.values()))), "gto_drift_vpip_signed": move["vpip"], "gto_drift_agg_signed": move["agg"]}
    # the very next action
    for s in post:
        turns = [[(a, b) for a, b in pairwise(by(h, s)) if mine(b) and not mine(a)] for h in chunk]
        after_check, after_bet = [[bet(b) for a, b in x if a["action_type"] == "check"] for x in turns], [bet(b) for x in turns for a, b in x if bet(a)]
        flat = [b for x in after_check for b in x]
        out |= {f"gto_probe_rate_{s}": z(share(flat)), f"gto_checked_to_count_{s}": len(flat), f"gto_raise_vs_bet_rate_{s}": z(share(after_bet)), f"gto_probe_rate_std_{s}": z(std(mean(x) for x in after_check if x))}
    replies = defaultdict(list)
    for h in chunk:
        for a, b in pairwise(h["actions"]):
            if bet(a) and not mine(a) and mine(b) and a["street"] == b["street"]:
                replies[a["street"]].append((b["action_type"], a["pot_before"] / (h["metadata"]["bb"] or 0.02) < 10))
    for s in STREETS:
        k = [x for x, _ in replies[s]]
        out |= {f"gto_response_entropy_{s}": plain_bits(k), f"gto_response_count_{s}": len(k), f"gto_fold_rate_vs_bet_{s}": q(k.count("fold"), len(k)), f"gto_call_rate_vs_bet_{s}": q(k.count("call"), len(k)), f"gto_raise_rate_vs_bet_{s}": q(sum(x in BETS for x in k), len(k))}
        out[f"gto_response_pot_sensitivity_{s}"] = abs(plain_bits(x for x, low in replies[s] if not low) - plain_bits(x for x, low in replies[s] if low))
    out["gto_postflop_response_entropy"] = plain_bits(x for s in post for x, _ in replies[s])
    # raises one over the other
    wars, depths, at_depth = Counter(), [], defaultdict(list)
    for h in chunk:
        depth = last = 0
        for a in by(h, "preflop"):
            depth += bet(a)
            if bet(a) and mine(a):
                wars[f"own{depth}"] += 1
                last = depth
            elif bet(a) and last == depth - 1 and last:
                wars[f"met{depth}"] += 1
            if mine(a) and depth:
                at_depth[depth].append(a["action_type"])
        depths.append(depth)
    met3 = wars["met2"] + wars["met3"]
    out |= {"at_hero_4bet_count": wars["own3"], "at_hero_5bet_count": wars["own5"], "at_3bet_faced_count": met3, "at_4bet_faced_count": wars["met4"], "at_hero_4bet_rate": wars["own3"] / max(1, met3), "at_hero_5bet_rate": wars["own5"] / max(1, wars["met4"]), "at_hero_4bet_per_hand": wars["own3"] / n, "at_hero_5bet_per_hand": wars["own5"] / n}
    out |= {"at_preflop_2bet_rate": depths.count(1) / n, "at_preflop_3bet_rate": depths.count(2) / n, "at_preflop_4bet_rate": depths.count(3) / n, "at_preflop_5bet_plus_rate": sum(d > 3 for d in depths) / n, "at_preflop_max_depth": max(depths), "at_preflop_depth_entropy": plain_bits(depths)}
    for d in (1, 2, 3):
        out |= {f"at_hero_action_entropy_at_{d}bet": plain_bits(at_depth[d]), f"at_hero_count_at_{d}bet": len(at_depth[d])}
    # stack to pot
    bucket = {"shallow": [], "medium": [], "deep": []}
    for h, k in zip(chunk, lines["flop"], strict=True):
        stack, flop = next((x["starting_stack"] or 0 for x in h["players"] if x["seat"] == hero), 0), by(h, "flop")
        if k and stack > 0 and flop[0]["pot_before"] > 0:
            spr = stack / flop[0]["pot_before"]
            bucket["shallow" if spr < 3 else "medium" if spr < 10 else "deep"].append(share(map(bet, k)))
    for b, x in bucket.items():
        out |= {f"at_hero_agg_{b}": z(mean(x)), f"at_hero_{b}_hand_count": len(x)}
    means = [np.mean(x) for x in bucket.values() if x]
    out |= {"at_spr_agg_variance": z(std(means)), "at_spr_agg_range": np.ptp(means) if means else 0.0}
    # few and many, in and out of position
    crowd, place = {True: [], False: []}, {True: [], False: []}
    for h in chunk:
        for s in post:
            few = len({a["actor_seat"] for a in by(h, s) if a["action_type"] != "fold"}) <= 2
            crowd[few] += [bet(a) for a in by(h, s) if mine(a)]
            if h["metadata"]["button_seat"] is not None and hero is not None:
                place[(h["metadata"]["button_seat"] - hero) % h["metadata"]["max_seats"] <= 1] += [bet(a) for a in by(h, s) if mine(a)]
    for x, one, other, names in ((crowd, "hu", "mw", ("hu_mw_agg_diff", "mw_ratio")), (place, "ip", "oop", ("ip_oop_agg_diff", "ip_ratio"))):
        yes, no = z(share(x[True])), z(share(x[False]))
        out |= {f"at_hero_{one}_postflop_agg": yes, f"at_hero_{other}_postflop_agg": no, f"at_hero_{names[0]}": yes - no, f"at_hero_{one}_hands": len(x[True]), f"at_hero_{other}_hands": len(x[False]), f"at_hero_{names[1]}": len(x[one == "ip"]) / max(1, len(x[True]) + len(x[False]))}
    # entropies of actions and sizes
    ent = {s: plain_bits(a["action_type"] for k in lines[s] for a in k) for s in STREETS}
    for s in STREETS:
        acts_ = [a for k in lines[s] for a in k]
        sizes = [round(round(a["amount"] / a["pot_before"] * 100) / 5) for a in acts_ if bet(a) and a["pot_before"] > 0 and a["amount"] > 0]
        out |= {f"at_hero_action_entropy_{s}": ent[s], f"at_hero_action_count_{s}": len(acts_), f"at_hero_bet_size_entropy_{s}": plain_bits(sizes)}
    some = [ent[s] for s in STREETS if any(lines[s])]
    out |= {"at_hero_action_entropy_mean": z(mean(some)), "at_hero_action_entropy_std": z(std(some))}
    # answers to hero's bets while the street lasts
    answers = []
    for h in chunk:
        for i, a in enumerate(h["actions"]):
            if mine(a) and bet(a):
                rest = next((b for b in h["actions"][i + 1 :] if b["street"] != a["street"] or not mine(b)), None)
                answers += [rest["action_type"]] if rest is not None and rest["street"] == a["street"] else []
    k = len(answers)
    return out | {"at_hero_bets_faced_by_villain": k, "at_villain_fold_to_hero_bet": q(answers.count("fold"), k), "at_villain_call_to_hero_bet": q(answers.count("call"), k), "at_villain_raise_to_hero_bet": q(sum(x in BETS for x in answers), k)}


SETS = {"actions": actions_set, "temporal": temporal_set, "context": context_set, "perhand": perhand_set, "hero": hero_set}
