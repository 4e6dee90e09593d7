"""Sequence conformance over ordered rows (rules applied to event tables, not only strings).

Both checks are single ``groupBy`` aggregations -- partial aggregation before the shuffle -- so a conversation or
user holding a third of all rows is combined map-side instead of being collected into one task. No
``collect_list`` / window over a whole group is needed:

* role alternation: with gapless turn numbers, the expected role of every turn follows from its parity (after an
  optional leading ``system`` turn); count the turns that disagree under both alignments and pick one by the first
  role.
* event path ``signup (view|click)+ purchase``: the first and last types (``min_by``/``max_by`` over (ts, id)), the
  count of each type and the length decide the anchored pattern exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values: roles and the event-path rule ----------------------------------------------------------------
ROLES = ("user", "assistant")
SYSTEM_ROLE = "system"
PATH_OPEN, PATH_CLOSE, PATH_MIDDLE, PATH_FORBIDDEN = "signup", "purchase", ("view", "click"), "error"
# -------------------------------------------------------------------------------------------------------------


def role_alternation(conv: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role") -> DataFrame:
    t, r = F.col(turn), F.col(role)
    exp0 = F.when(t % 2 == 0, ROLES[0]).otherwise(ROLES[1])
    exp1 = F.when((t - 1) % 2 == 0, ROLES[0]).otherwise(ROLES[1])
    g = conv.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_turns"), F.min(t).alias("_min"), F.max(t).alias("_max"),
        F.count_distinct(t).alias("_turns"),
        F.min_by(r, t).alias("first_role"),
        F.count_if(r != exp0).alias("_bad0"),
        F.count_if((t > 0) & (r != exp1)).alias("_bad1"))
    has_sys = F.col("first_role") == SYSTEM_ROLE
    body = F.when(has_sys, F.col("n_turns") - 1).otherwise(F.col("n_turns"))
    bad = F.when(has_sys, F.col("_bad1")).otherwise(F.col("_bad0"))
    gapless = (F.col("_min") == 0) & (F.col("_max") == F.col("n_turns") - 1) & (F.col("_turns") == F.col("n_turns"))
    valid = gapless & (bad == 0) & (body >= 2) & (body % 2 == 0)
    return g.select(key, "n_turns", has_sys.alias("has_system"), bad.cast("int").alias("n_bad"),
                    gapless.alias("gapless"), valid.alias("valid"))


def event_path(events: DataFrame, key: str = "user_id") -> DataFrame:
    order = F.struct(F.col("ts"), F.col("event_id"))
    et = F.col("event_type")
    g = events.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_events"), F.min_by(et, order).alias("first_type"),
        F.max_by(et, order).alias("last_type"),
        F.count_if(et == PATH_OPEN).alias("_n_open"), F.count_if(et == PATH_CLOSE).alias("_n_close"),
        F.count_if(~et.isin(PATH_OPEN, PATH_CLOSE, *PATH_MIDDLE)).alias("_n_other"))
    valid = ((F.col("n_events") >= 3) & (F.col("first_type") == PATH_OPEN) & (F.col("last_type") == PATH_CLOSE)
             & (F.col("_n_open") == 1) & (F.col("_n_close") == 1) & (F.col("_n_other") == 0))
    return g.select(key, "n_events", "first_type", "last_type", valid.alias("valid"))
