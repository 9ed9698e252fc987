"""The canonical view of a hand: masked, normalised, coarsened and sampled, by hashes of its own content.

All steps are array functions over the nested row: no shuffle, no Python. In
hash seeds a field that is missing is empty. A fixed schema can't tell a null
from it; a VARIANT of the same hand, if there is one, can: null is `None` then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.operators import variants

SB, BB = 0.01, 0.02
WINDOW_MIN, WINDOW_MAX, COPIES = 5, 8, 12
CAP_STACK, CAP_ACTION, CAP_POT = 500.0, 200.0, 1000.0
# Amounts in big blinds to which money is rounded, zero aside.
BUCKETS = (0.5, 1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0, 12.0, 16.0, 24.0, 36.0, 56.0, 84.0, 126.0)
KINDS = ("small_blind", "big_blind", "ante", "check", "call", "bet", "raise", "fold")
#: Fields that never leave: labels and what would tell them.
PRIVATE = ("label", "label_flag", "is_bot", "bot_family_id", "bot_version")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once: a plain column would be worked out wherever body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def to_bb(x: Column, bb: Column, cap: float) -> Column:
    """Money in big blinds within [0, cap], two places; 0 without a big blind."""
    v = F.bround(F.least(F.greatest(x / bb, F.lit(0.0)), F.lit(cap)), 2)
    return F.when((bb > 0) & x.isNotNull() & ~F.isnan(x), v).otherwise(F.lit(0.0))


def from_bb(x: Column) -> Column:
    return F.bround(F.greatest(x, F.lit(0.0)) * BB, 4)


def seat_or_zero(seat: Column, most: Column | int) -> Column:
    most = most if isinstance(most, Column) else F.lit(most)
    return F.when((seat >= 1) & (seat <= most), seat).otherwise(F.lit(0))


def kind_of(raw: Column) -> Column:
    """The action's name if it is known or tells one, else empty."""
    plain = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    out = F.when(plain.isin(*KINDS), plain)
    for word in ("raise", "bet", "call", "check", "fold"):
        out = out.when(plain.contains(word), F.lit(word))
    return out.when(plain.contains("muck"), F.lit("fold")).otherwise(F.lit(""))


def hash_noise(seed: Column) -> Column:
    """A number in [-1, 1] from the second byte of the seed's SHA-256."""
    return F.conv(F.substring(F.sha2(seed, 256), 3, 2), 16, 10).cast("double") / 255.0 * 2.0 - 1.0


def coarse(bb: Column, seed: Column) -> Column:
    """The nearest bucket, moved by hash noise in proportion; 0 stays 0."""
    buckets = F.array(*[F.lit(b) for b in BUCKETS])

    def moved(nearest: Column) -> Column:
        spread = F.when(nearest <= 1.5, F.lit(0.08)).when(nearest <= 8.0, F.lit(0.22)).otherwise(F.greatest(F.lit(0.35), nearest * 0.05))
        return F.bround(F.greatest(F.lit(0.0), F.least(F.lit(BUCKETS[-1]), nearest + hash_noise(seed) * spread)), 2)

    return F.when(bb <= 0, F.lit(0.0)).otherwise(let(bb, lambda x: let(F.array_min(F.transform(buckets, lambda b: F.struct(F.abs(b - x).alias("d"), b.alias("b"))))["b"], moved)))


def seat_order(action_seats: Column, player_seats: Column, max_seats: Column) -> Column:
    """Seats in the order of their first action, then of the player list, then by number: a seat's alias is its place."""
    every = F.concat(F.coalesce(action_seats, F.array().cast("array<int>")), F.coalesce(player_seats, F.array().cast("array<int>")), F.sequence(F.lit(1), max_seats))
    return F.array_distinct(F.filter(every, lambda s: (s >= 1) & (s <= max_seats)))


def _alias(order: Column, seat: Column) -> Column:
    return F.array_position(order, seat).cast("int")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _resolved(direct: Column, amount: Column, raise_to: Column, call_to: Column, before: Column, after: Column) -> Column:
    guess = F.when(raise_to > 0, "raise").when(call_to > 0, "call").when((amount > 0) & (after > before), "bet").when(amount > 0, "call").when(after <= before, "check").otherwise("call")
    return F.when(direct != "", direct).otherwise(guess)


def collapse(actions: Column) -> Column:
    """Without check or fold rows that move no money and repeat the row before (kind, seat, street)."""
    idle = lambda x: (x["normalized_amount_bb"] <= 0) & (x["pot_after"] <= x["pot_before"]) & x["action_type"].isin("check", "fold")
    same = lambda x, y: (x["action_type"] == y["action_type"]) & (x["actor_seat"] == y["actor_seat"]) & (x["street"] == y["street"])
    return let(actions, lambda every: F.filter(every, lambda x, i: ~((i > 0) & idle(x) & idle(F.get(every, i - 1)) & same(x, F.get(every, i - 1)))))


def window_size(seed: Column) -> Column:
    """5 to 8 by the first byte of the seed's SHA-256."""
    return (F.lit(WINDOW_MIN) + F.pmod(F.conv(F.substring(F.sha2(seed, 256), 1, 2), 16, 10).cast("int"), F.lit(WINDOW_MAX - WINDOW_MIN + 1))).cast("int")


def visible_places(streets: Column, seed: Column) -> Column:
    """Places (from 0) that stay of a list of streets: first and last, the least hash of each street, then the least hashes, in order.

    A single row is shown COPIES times.
    """
    key = lambda i, s: F.sha2(F.concat(seed, F.lit(":"), i.cast("string"), F.lit(":"), s), 256)

    def pick(every: Column) -> Column:
        n = F.size(every)
        inner = F.filter(F.transform(every, lambda s, i: F.struct(F.when(s == "", F.lit("preflop")).otherwise(F.lower(s)).alias("s"), i.alias("i"))), lambda x: (x["i"] > 0) & (x["i"] < n - 1))
        chosen = let(F.least(n, window_size(seed)), lambda w: F.when(n <= w, F.sequence(F.lit(0), n - 1)).otherwise(let(inner, lambda rows: fill(rows, w, n))))
        return F.when(n == 1, F.array_repeat(F.lit(0), COPIES)).when(n > 1, chosen).otherwise(F.array().cast("array<int>"))

    def fill(rows: Column, w: Column, n: Column) -> Column:
        hashed = lambda x, s: F.struct(key(x["i"], s).alias("k"), x["i"].alias("i"))
        least = lambda s: F.array_min(F.transform(F.filter(rows, lambda x: x["s"] == s), lambda x: hashed(x, x["s"])))["i"]
        names = F.array_sort(F.array_distinct(F.transform(rows, lambda x: x["s"])))
        firsts = F.slice(F.transform(names, least), F.lit(1), F.greatest(w - 2, F.lit(0)))

        def rest(f: Column) -> Column:
            others = F.array_sort(F.transform(F.filter(rows, lambda x: ~F.array_contains(f, x["i"])), lambda x: hashed(x, F.lit(""))))
            more = F.transform(F.slice(others, F.lit(1), F.greatest(w - 2 - F.size(f), F.lit(0))), lambda x: x["i"])
            return F.array_sort(F.concat(F.array(F.lit(0), n - 1), f, more))

        return let(firsts, rest)

    return let(streets, pick)


def canonical(hands: DataFrame, column: str = "hand", raw: str | None = None) -> DataFrame:
    """hands with `column` (see longform.HAND_DDL) replaced by its canonical view. raw: a column with the same hand as VARIANT, for seeds."""
    h = lambda p: F.col(f"{column}.{p}")
    most = F.greatest(F.lit(6), F.coalesce(seat_or_zero(h("metadata.max_seats"), 10), F.lit(0)))
    bb = F.coalesce(h("metadata.bb"), F.lit(0.0))
    order = seat_order(F.transform(h("actions"), lambda a: a["actor_seat"]), F.transform(h("players"), lambda p: p["seat"]), most)
    given = lambda path: _text(h(path)) if raw is None else variants.seed_text(variants.field(F.col(raw), f"$.{path}"))

    def seed_of(a: Column, i: Column) -> Callable[[str], Column]:
        own = lambda name: _text(a[name]) if raw is None else variants.seed_text(variants.field(F.get(variants.items(F.col(raw), "$.actions"), i), f"$.{name}"))
        return lambda name: F.concat_ws("|", given("metadata.hero_seat"), given("metadata.max_seats"), own("street"), own("actor_seat"), own("action_id"), F.lit(name))

    def money(a: Column, i: Column, order: Column) -> Column:
        seed = seed_of(a, i)
        c = lambda name, cap: coarse(to_bb(a[name], bb, cap), seed(name))
        row = lambda before: F.struct(
            kind_of(a["action_type"]).alias("direct"), _text(a["street"]).alias("street"), F.coalesce(_alias(order, seat_or_zero(a["actor_seat"], most)), F.lit(0)).alias("seat"),
            c("amount", CAP_ACTION).alias("amount"), c("raise_to", CAP_POT).alias("raise_to"), c("call_to", CAP_POT).alias("call_to"),
            before.alias("before"), coarse(F.greatest(before, to_bb(a["pot_after"], bb, CAP_POT)), seed("pot_after")).alias("after"),
        )
        return let(c("pot_before", CAP_POT), row)

    named = lambda a: a.withField("kind", _resolved(a["direct"], a["amount"], a["raise_to"], a["call_to"], a["before"], a["after"]))
    empty = lambda a: (a["direct"] == "") & (a["amount"] <= 0) & (a["raise_to"] <= 0) & (a["call_to"] <= 0) & (a["after"] <= a["before"])
    shown = lambda a: F.struct(
        F.lit("").alias("action_id"), a["street"].alias("street"), a["seat"].alias("actor_seat"), a["kind"].alias("action_type"), from_bb(a["amount"]).alias("amount"),
        F.when(a["raise_to"] > 0, from_bb(a["raise_to"])).alias("raise_to"), F.when(a["call_to"] > 0, from_bb(a["call_to"])).alias("call_to"),
        a["amount"].alias("normalized_amount_bb"), from_bb(a["before"]).alias("pot_before"), from_bb(a["after"]).alias("pot_after"),
    )

    def sampled(rows: Column) -> Column:
        pick = F.concat_ws("|", given("metadata.hero_seat"), given("metadata.max_seats"), _text(F.get(rows, 0)["street"]), F.size(rows).cast("string"))
        places = visible_places(F.transform(rows, lambda a: a["street"]), pick)
        return F.transform(places, lambda i, k: F.get(rows, i).withField("action_id", (k + 1).cast("string")))

    def actions(order: Column) -> Column:
        rows = F.transform(F.transform(F.coalesce(h("actions"), F.array()), lambda a, i: money(a, i, order)), named)
        kept = F.filter(rows, lambda a: ~a["kind"].isin("small_blind", "big_blind", "ante") & ~empty(a))
        return let(collapse(F.transform(kept, shown)), sampled)

    def players(order: Column) -> Column:
        alias = lambda p: _alias(order, seat_or_zero(p["seat"], most))
        seats = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce(h("players"), F.array()), alias), lambda s: s > 0)))
        stack = lambda s: F.element_at(F.filter(h("players"), lambda p: alias(p) == s), -1)["starting_stack"]  # noqa: E731  the last of a seat counts
        return F.transform(seats, lambda s: F.struct(F.concat(F.lit("seat_"), s.cast("string")).alias("player_uid"), s.alias("seat"), from_bb(to_bb(stack(s), bb, CAP_STACK)).alias("starting_stack"), F.lit(None).cast("array<string>").alias("hole_cards"), F.lit(False).alias("showed_hand")))

    hero = F.coalesce(let(order, lambda o: _alias(o, seat_or_zero(h("metadata.hero_seat"), most))), F.lit(0))
    meta = F.struct(
        _text(h("metadata.game_type")).alias("game_type"), _text(h("metadata.limit_type")).alias("limit_type"), F.greatest(F.lit(2), F.size(order)).alias("max_seats"), hero.alias("hero_seat"),
        _text(h("metadata.hand_ended_on_street")).alias("hand_ended_on_street"), F.lit(0).alias("button_seat"), F.lit(SB).alias("sb"), F.lit(BB).alias("bb"), F.lit(0.0).alias("ante"), F.lit(None).cast("string").alias("rng_seed_commitment"),
    )
    boards = F.transform(F.coalesce(h("streets"), F.array()), lambda s: F.struct(_text(s["street"]).alias("street"), F.array().cast("array<string>").alias("board_cards")))
    outcome = F.struct(F.array().cast("array<string>").alias("winners"), F.create_map().cast("map<string,double>").alias("payouts"), F.lit(0.0).alias("total_pot"), F.lit(0.0).alias("rake"), F.lit("").alias("result_reason"), F.lit(False).alias("showdown"))
    view = F.struct(F.lit(None).cast("string").alias("hand_id"), meta.alias("metadata"), let(order, players).alias("players"), boards.alias("streets"), let(order, actions).alias("actions"), outcome.alias("outcome"))
    return hands.withColumn(column, view)


def chunk_signature(hand: DataFrame, act: DataFrame) -> DataFrame:
    """chunk_id and nine means per hand: calls, checks, raises, folds, actions, streets, players, amount_bb, pot_after."""
    n = hand.groupBy("chunk_id").agg(F.count("*").alias("n"), F.avg("n_streets").alias("streets"), F.avg("n_players").alias("players"))
    kinds = {"calls": ("call",), "checks": ("check",), "raises": ("bet", "raise"), "folds": ("fold",)}
    a = act.groupBy("chunk_id").agg(*[F.count_if(F.col("kind").isin(*k)).alias(c) for c, k in kinds.items()], F.count("*").alias("actions"), F.sum("amt_bb").alias("amount_bb"), F.sum("pot_after").alias("pot_after"))
    each = [*kinds, "actions", "amount_bb", "pot_after"]
    return n.join(a, "chunk_id", "left").select("chunk_id", "streets", "players", *[(F.coalesce(F.col(c), F.lit(0)) / F.col("n")).alias(c) for c in each])
