"""Shared SQL common table expressions for the oracle side of the registered queries."""

from __future__ import annotations

TILE = 432000  # five days, the metric window of the registered queries

CTES: dict[str, tuple[str, str]] = {
    # name: (names it needs, body)
    "ev": ("", "SELECT user_id // 15 AS recid, user_id AS uid, epoch_us(ts) / 1e6 AS t, event_id AS eid, "
               "event_type AS kind, value FROM events"),
    "trg": ("ev", "SELECT recid, eid AS win_id, t, value AS amp FROM ev WHERE kind = 'purchase'"),
    "art": ("ev", "SELECT recid, eid AS win_id, t - 0 AS t0, t + 1800 AS t1 FROM ev WHERE kind = 'error'"),
    "quiet": ("ev", "SELECT recid, eid AS win_id, t - 3600 AS t0, t + 3600 AS t1 FROM ev WHERE kind = 'signup'"),
    "win": ("ev", f"SELECT recid, win_id, win_id * CAST({TILE} AS DOUBLE) AS t0, (win_id + 1) * CAST({TILE} AS DOUBLE) AS t1 "
                  f"FROM (SELECT DISTINCT recid, CAST(floor(t / {TILE}) AS BIGINT) AS win_id FROM ev)"),
    "evw": ("ev win", "SELECT e.recid, e.uid, e.t, e.eid, e.kind, e.value, w.win_id, w.t0, w.t1 "
                      "FROM ev e JOIN win w ON e.recid = w.recid AND e.t BETWEEN w.t0 AND w.t1"),
    "isi": ("evw", "SELECT * FROM (SELECT recid, uid, win_id, t, eid, "
                   "t - lag(t) OVER g AS isi, lead(t) OVER g - t AS nxt FROM evw "
                   "WINDOW g AS (PARTITION BY recid, uid, win_id ORDER BY t, eid)) WHERE isi IS NOT NULL"),
    "tr": ("ev", "SELECT recid, row_number() OVER (PARTITION BY recid ORDER BY t, eid) - 1 AS i, t, value AS v FROM ev"),
    "units": ("", "SELECT c_custkey AS uid, n_name AS area, r_name AS region, c_mktsegment AS seg, c_acctbal AS bal, "
                  "c_nationkey AS nat FROM customer JOIN nation ON c_nationkey = n_nationkey "
                  "JOIN region ON n_regionkey = r_regionkey"),
}


def with_ctes(needs: str, body: str, **extra: str) -> str:
    """``body`` preceded by the named CTEs (and what they need) and by ``extra`` ones in given order."""
    done: list[str] = []

    def add(name: str) -> None:
        if name in done:
            return
        for n in CTES[name][0].split():
            add(n)
        done.append(name)

    for n in needs.split():
        add(n)
    parts = [f"{n} AS ({CTES[n][1]})" for n in done] + [f"{n} AS ({b})" for n, b in extra.items()]
    return f"WITH {', '.join(parts)} {body}"
