"""Which calls belong together.

A call (``callid``) has a session: the least non-empty ``callid_rc`` among its
rows, or else its own id. The keys of a session are the session id itself and
every call that names it in ``callid_rc``. A message is in the flow of a session
if its ``callid`` or its ``callid_rc`` is one of the keys.

The keys of a seed call depend on its session alone, since a call that has a
session is one of the calls that name it. So flows are built once per session,
and never per pair of a seed and a message.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def call_pairs(capture: DataFrame) -> DataFrame:
    """Distinct ``(callid, callid_rc)``, empty text where missing: the small base of all steps."""
    return capture.select(
        F.coalesce("callid", F.lit("")).alias("callid"),
        F.coalesce("callid_rc", F.lit("")).alias("callid_rc"),
    ).distinct()


def session_calls(pairs: DataFrame) -> DataFrame:
    """Distinct calls of each session id: ``(session, callid)``."""
    named = pairs.where("callid <> '' AND callid_rc <> ''")
    return named.select(F.col("callid_rc").alias("session"), "callid").distinct()


def call_sessions(pairs: DataFrame) -> DataFrame:
    """The session of each call: ``(callid, session)``."""
    calls = pairs.where("callid <> ''").groupBy("callid")
    own = calls.agg(F.min(F.nullif("callid_rc", F.lit(""))).alias("rc"))
    return own.select("callid", F.coalesce("rc", "callid").alias("session"))


def session_keys(pairs: DataFrame) -> DataFrame:
    """``(session, key)`` for each session that some call has."""
    sessions = call_sessions(pairs).select("session").distinct()
    calls = session_calls(pairs).join(sessions, "session", "left_semi")
    return sessions.select("session", F.col("session").alias("key")).union(calls.select("session", "callid")).distinct()


def pair_sessions(pairs: DataFrame) -> DataFrame:
    """``(callid, callid_rc, session)``: the flows that rows with this pair are in.

    Two equality joins and a union. Joining on either-or would compare every
    pair with every key.
    """
    keys = session_keys(pairs)
    by_call = pairs.join(keys, pairs.callid == keys.key).select("callid", "callid_rc", "session")
    by_session = pairs.join(keys, pairs.callid_rc == keys.key).select("callid", "callid_rc", "session")
    return by_call.union(by_session).distinct()
