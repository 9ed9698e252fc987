"""The driver tables as hands, players and actions, so that feature sets run over them.

Binding E, over `events`: a chunk is a table of six users, so chunks grow with
the users, each of whom is a seat; a hand is half a day of a chunk, the order is
(ts, event_id), streets are quarters of the half day. Money is counted in whole
cents, so that sums are the same in any order.
"""

from __future__ import annotations

from quillon.functions.sql import Flow

SEATS = 6


def events_as_hands() -> list[tuple[str, str]]:
    """Steps that make hand, play and act from a table `events`, in SQL that both engines read."""
    f = Flow()
    f.step(
        "ev",
        f"""SELECT CAST(floor(user_id / {SEATS}.0) AS BIGINT) AS chunk_id, CAST(ts AS DATE) AS day, CAST(floor(hour(ts) / 12.0) AS INT) AS half, hour(ts) AS h, ts, event_id, user_id, event_type, CAST(round(value * 10) AS BIGINT) AS cents
        FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL""",
    )
    f.step("hn", "SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY day, half) - 1 AS hand_ix FROM (SELECT DISTINCT chunk_id, day, half FROM ev) d")
    f.step(
        "hx",
        f"""SELECT e.*, n.hand_ix, CASE CAST(floor((h % 12) / 3.0) AS INT) WHEN 0 THEN 'preflop' WHEN 1 THEN 'flop' WHEN 2 THEN 'turn' ELSE 'river' END AS street,
        CAST(user_id % {SEATS} + 1 AS INT) AS seat,
        CASE WHEN event_id % 13 = 0 THEN 'small_blind' WHEN event_id % 17 = 0 THEN 'big_blind' WHEN event_type = 'error' THEN 'fold' WHEN event_type = 'view' THEN 'check' WHEN event_type = 'click' THEN 'call'
             WHEN event_type = 'signup' THEN 'bet' WHEN event_id % 11 = 0 THEN 'all_in' ELSE 'raise' END AS kind
        FROM ev e JOIN hn n ON n.chunk_id = e.chunk_id AND n.day = e.day AND n.half = e.half""",
    )
    f.step(
        "ax",
        """SELECT *, CASE WHEN kind IN ('fold', 'check') THEN 0 ELSE cents END AS paid,
        row_number() OVER (PARTITION BY chunk_id, hand_ix ORDER BY ts, event_id) - 1 AS act_ix FROM hx""",
    )
    f.step("bx", "SELECT *, 100 + coalesce(sum(paid) OVER (PARTITION BY chunk_id, hand_ix ORDER BY act_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pot FROM ax")
    f.step(
        "act",
        """SELECT chunk_id, hand_ix, act_ix, street, seat, kind, paid / CAST(100 AS DOUBLE) AS amount, CASE WHEN kind IN ('raise', 'all_in') THEN paid * 2 / CAST(100 AS DOUBLE) END AS raise_to,
        CASE WHEN kind = 'call' THEN paid / CAST(100 AS DOUBLE) END AS call_to, paid / CAST(50 AS DOUBLE) AS amt_bb, pot / CAST(100 AS DOUBLE) AS pot_before, (pot + paid) / CAST(100 AS DOUBLE) AS pot_after FROM bx""",
    )
    f.step("hd", "SELECT chunk_id, hand_ix, count(DISTINCT street) - 1 AS n_streets, CAST((chunk_id + CASE WHEN hand_ix % 9 = 0 THEN 1 ELSE 0 END) % 6 + 1 AS INT) AS hero_seat FROM act GROUP BY chunk_id, hand_ix")
    f.step("ps", "SELECT DISTINCT chunk_id, hand_ix, seat FROM act UNION SELECT chunk_id, hand_ix, hero_seat FROM hd")
    f.step("play", "SELECT chunk_id, hand_ix, seat AS play_ix, seat, CAST(20 + (hand_ix * 7 + seat * 13) % 40 AS DOUBLE) AS stack FROM ps")
    f.step("np", "SELECT chunk_id, hand_ix, count(*) AS n FROM ps GROUP BY chunk_id, hand_ix")
    f.step(
        "hand",
        """SELECT h.chunk_id, h.hand_ix, n.n AS n_players, h.n_streets, h.hero_seat, CAST(h.hand_ix % 6 + 1 AS INT) AS button_seat, 6 AS max_seats, CAST(0.5 AS DOUBLE) AS bb,
        h.hand_ix % 3 = 0 AS showdown, CASE WHEN h.hand_ix % 4 = 1 THEN concat(',', CAST(h.hero_seat AS STRING), ',') ELSE ',' END AS winners FROM hd h JOIN np n ON n.chunk_id = h.chunk_id AND n.hand_ix = h.hand_ix""",
    )
    return f.steps
