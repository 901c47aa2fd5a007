"""Queries of machines made of machines, per user."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.catalog import query
from tidemark.operators import machines, scans
from tidemark.plans.inputs import events

_E = "(SELECT event_id AS seq, user_id, event_type, value FROM events)"
_numbered = lambda: machines.Stateful(0, lambda n, row: (n + 1, [(row[0], n + 1)]))
_summed = lambda: machines.Stateful(0, lambda n, row: (n + row[-1], [(*row[:-1], n + row[-1])]))


def _per_user(name, sql, columns, machine, schema):
    query(name, sql)(lambda s, d: scans.run(events(s, d, "user_id", *columns), machine, f"user_id long, {schema}", "user_id"))


_per_user("scan_and_then", f"SELECT user_id, seq, CAST(k * (k + 1) // 2 AS BIGINT) AS total FROM (SELECT user_id, seq, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS k FROM {_E})", ["value"], machines.AndThen(_numbered(), _summed()), "seq long, total long")
_per_user("scan_lens", f"SELECT user_id, seq, event_type, CAST(count(*) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS n FROM {_E}", ["event_type", "value"], machines.on(machines.Stateful(0, lambda n, row: (n + 1, [(n + 1,)])), 2), "seq long, event_type string, n long")
_CLICKS = f"SELECT user_id, seq, event_type, CASE WHEN event_type = 'click' THEN row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY seq) ELSE {{other}} END AS n FROM {_E}"
_is_click = lambda row: row[1] == "click"
_counted = lambda step: machines.Stateful(0, lambda n, row: (n + step, [(row[0], row[1], n + step)]))
_per_user("scan_choice", _CLICKS.format(other="-row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY seq)"), ["event_type"], machines.Choice(_is_click, _counted(1), _counted(-1)), "seq long, event_type string, n long")
_per_user("scan_left", _CLICKS.format(other="0"), ["event_type"], machines.Dimap(machines.left(_counted(1), _is_click), after=lambda row: (*row[:2], row[2] if len(row) > 2 else 0)), "seq long, event_type string, n long")
_per_user("scan_semipass", f"SELECT user_id, seq, CASE WHEN event_type = 'click' THEN 'click' || row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY seq) ELSE event_type END AS said FROM {_E}", ["event_type"], machines.semipass(machines.Stateful(0, lambda n, row: (n + 1, [(row[0], f"click{n + 1}")])), lambda row: (True, row) if row[1] == "click" else (False, tuple(row))), "seq long, said string")
query("scan_stateless", f"SELECT user_id, seq, k FROM {_E}, (SELECT unnest(range(0, 2)) AS k)")(lambda s, d: scans.run(events(s, d, "user_id", "value"), machines.stateless(lambda row: [(row.seq, k) for k in range(2)]), "user_id long, seq long, k long", "user_id").select("user_id", "seq", F.col("k")))
