"""Role alternation and event-path rules on small hand-built fixtures."""

import datetime as dt

from seqlab.operators.conformance import event_path, role_alternation


def test_role_alternation(spark):
    rows = ([(1, 0, "user"), (1, 1, "assistant")]
            + [(2, 0, "system"), (2, 1, "user"), (2, 2, "assistant"), (2, 3, "user"), (2, 4, "assistant")]
            + [(3, 0, "user"), (3, 1, "user")]
            + [(4, 0, "user"), (4, 1, "assistant"), (4, 2, "user")]
            + [(5, 0, "system"), (5, 1, "assistant"), (5, 2, "user")])
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string")
    got = {r.conv_id: (r.valid, r.has_system, r.n_bad) for r in role_alternation(df).collect()}
    assert got == {1: (True, False, 0), 2: (True, True, 0), 3: (False, False, 1), 4: (False, False, 0),
                   5: (False, True, 2)}


def test_event_path(spark):
    t = lambda s: dt.datetime(2024, 1, 1, 0, 0, s)
    rows = [(1, t(1), 7, "signup"), (2, t(2), 7, "view"), (3, t(3), 7, "click"), (4, t(4), 7, "purchase"),
            (5, t(1), 8, "signup"), (6, t(2), 8, "purchase"),
            (7, t(1), 9, "signup"), (8, t(2), 9, "error"), (9, t(3), 9, "purchase")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string")
    got = {r.user_id: r.valid for r in event_path(df).collect()}
    assert got == {7: True, 8: False, 9: False}
