"""Long tables of hands, players and actions from nested hand documents: the only explode.

Every table carries its ordinals (chunk_id, hand_ix, act_ix); nothing relies on
the order of rows. Unknown fields are ignored, missing ones are null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import bucketed, materialised

HAND_DDL = (
    "struct<hand_id:string,"
    "metadata:struct<game_type:string,limit_type:string,max_seats:int,hero_seat:int,hand_ended_on_street:string,button_seat:int,sb:double,bb:double,ante:double,rng_seed_commitment:string>,"
    "players:array<struct<player_uid:string,seat:int,starting_stack:double,hole_cards:array<string>,showed_hand:boolean>>,"
    "streets:array<struct<street:string,board_cards:array<string>>>,"
    "actions:array<struct<action_id:string,street:string,actor_seat:int,action_type:string,amount:double,raise_to:double,call_to:double,normalized_amount_bb:double,pot_before:double,pot_after:double>>,"
    "outcome:struct<winners:array<string>,payouts:map<string,double>,total_pot:double,rake:double,result_reason:string,showdown:boolean>,"
    "label:string>"
)


#: Actions of a bucket, about: what a task holds of them in each sort of its plan stays within the page that the sort takes anyway.
BUCKET_ROWS = 250_000


def bucket_count(spark: SparkSession, actions: int) -> int:
    """Buckets of so many actions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-actions // BUCKET_ROWS))


@dataclass(frozen=True)
class HandTables:
    """hand: a row for each hand (winners: seats between commas); play: for each player of a hand; act: for each action of a hand."""

    hand: DataFrame
    play: DataFrame
    act: DataFrame
    buckets: int = 0  # by chunk_id, 0 if they aren't bucketed

    def bound(self, actions: int | None = None) -> HandTables:
        """The tables written once in buckets of chunk_id, so that feature sets, all of whose groups and joins are by it, move no row again.

        actions: how many there are, where that is known; else they are written down to be counted.
        """
        if self.buckets:
            return self
        act = self.act if actions is not None else materialised(self.act)
        actions = act.count() if actions is None else actions
        n = bucket_count(act.sparkSession, actions)
        return HandTables(*(bucketed(t, "chunk_id", n) for t in (self.hand, self.play, act)), n)


def action_kind(raw):
    """Canonical action name: lower case, trimmed, `allin` and `all-in` as all_in."""
    plain = F.lower(F.trim(raw))
    return F.when(plain.isin("allin", "all-in"), F.lit("all_in")).otherwise(plain)


def long_tables(chunks: DataFrame) -> HandTables:
    """From (chunk_id, hand_ix, hand) with `hand` of HAND_DDL. Hands without actions or players stay as hands."""
    h = chunks.select("chunk_id", "hand_ix", "hand")
    hand = h.select(
        "chunk_id",
        "hand_ix",
        F.coalesce(F.size("hand.players"), F.lit(0)).alias("n_players"),
        F.coalesce(F.size("hand.streets"), F.lit(0)).alias("n_streets"),
        F.col("hand.metadata.hero_seat").alias("hero_seat"),
        F.col("hand.metadata.button_seat").alias("button_seat"),
        F.greatest(F.lit(1), F.coalesce("hand.metadata.max_seats", F.lit(6))).alias("max_seats"),
        F.coalesce("hand.metadata.bb", F.lit(0.02)).alias("bb"),
        F.coalesce("hand.outcome.showdown", F.lit(False)).alias("showdown"),
        F.concat(F.lit(","), F.coalesce(F.array_join("hand.outcome.winners", ","), F.lit("")), F.lit(",")).alias("winners"),
    ).withColumns({c: F.when(F.col(c) >= 0, F.col(c)).otherwise(0) for c in ("n_players", "n_streets")})
    p = h.select("chunk_id", "hand_ix", F.posexplode("hand.players").alias("play_ix", "p"))
    play = p.select("chunk_id", "hand_ix", "play_ix", F.col("p.seat").alias("seat"), F.col("p.starting_stack").alias("stack"))
    a = h.select("chunk_id", "hand_ix", F.posexplode("hand.actions").alias("act_ix", "a"))
    act = a.select(
        "chunk_id",
        "hand_ix",
        "act_ix",
        F.col("a.street").alias("street"),
        F.col("a.actor_seat").alias("seat"),
        action_kind(F.col("a.action_type")).alias("kind"),
        F.coalesce("a.amount", F.lit(0.0)).alias("amount"),
        F.col("a.raise_to").alias("raise_to"),
        F.col("a.call_to").alias("call_to"),
        F.coalesce("a.normalized_amount_bb", F.lit(0.0)).alias("amt_bb"),
        F.coalesce("a.pot_before", F.lit(0.0)).alias("pot_before"),
        F.coalesce("a.pot_after", F.lit(0.0)).alias("pot_after"),
    )
    return HandTables(hand, play, act)


def in_chunks(hands: DataFrame, size: int, group: str = "file", order: str = "pos") -> DataFrame:
    """(chunk_id, hand_ix, hand): tumbling chunks of `size` hands of each group in order; the last, short one is dropped."""
    numbered = hands.withColumn("hand_ix", F.expr(f"{order} % {size}")).withColumn("n", F.expr(f"{order} div {size}"))
    if size == 1:  # no chunk is short, so hands needn't be moved
        return numbered.select(F.concat_ws("#", F.col(group), F.col("n").cast("string")).alias("chunk_id"), "hand_ix", "hand")
    full = numbered.groupBy(group, "n").agg(F.count("*").alias("c")).where(F.col("c") == size).drop("c")
    return numbered.join(full, [group, "n"]).select(F.concat_ws("#", F.col(group), F.col("n").cast("string")).alias("chunk_id"), "hand_ix", "hand")
