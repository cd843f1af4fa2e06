"""Queries over event sequences: one user = one atom stream in (ts, event_id) order."""

from __future__ import annotations

from ..catalog import register, table
from ..operators.sequence import Compiled, match_each, match_sequence, sequence_sql

# Rule sets of the registered queries (data, not code).
EVENT_RULES = {"Browse": "view+ click", "Checkout": "click purchase", "Trouble": "error error+"}
EVENT_MACHINES = {
    "funnel": {"Visit": "view+ click? purchase"},
    "errors": {"Burst": "error error+", "Single": "error"},
    "blocks": {"Block": "signup click+", "Comment": "click+", "Code": "_+"},
}

EVENT_SEQUENCES_SQL = "SELECT * FROM " + sequence_sql(Compiled(EVENT_RULES), "events", "user_id", "ts, event_id",
                                                     "event_type")

EVENT_PATTERNS_SQL = "\nUNION ALL\n".join(
    "SELECT * FROM " + sequence_sql(Compiled(rules), "events", "user_id", "ts, event_id", "event_type", machine=name)
    for name, rules in EVENT_MACHINES.items())


@register("event_sequences", EVENT_SEQUENCES_SQL)
def q_event_sequences(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return match_sequence(ev, "user_id", ["ts", "event_id"], "event_type", EVENT_RULES)


@register("event_patterns", EVENT_PATTERNS_SQL)
def q_event_patterns(spark, sf):
    ev = table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return match_each(ev, "user_id", ["ts", "event_id"], "event_type", EVENT_MACHINES)
