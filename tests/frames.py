"""Small hand-written frames for the hazards (FIXTURES.md section D)."""

import datetime as dt

INTERACTION_DDL = ("interaction_id string, customer_id long, touchpoint string, "
                   "timestamp timestamp, session_duration_minutes long, pages_viewed long, "
                   "action_taken string, revenue double, campaign_id string")


def t(text):
    return dt.datetime.fromisoformat(text)


def interactions(spark, rows):
    """rows: (id, customer, touchpoint, time text, revenue[, session])."""
    full = []
    for r in rows:
        iid, cust, tp, when, rev = r[:5]
        sess = r[5] if len(r) > 5 else 10
        full.append((iid, cust, tp, t(when) if when else None, sess, None, "view", rev, None))
    return spark.createDataFrame(full, INTERACTION_DDL)
