"""pitwall: live leaderboard, metrics-anomaly and commentary analytics on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function. Batch forms live in
``pitwall.operators``; Structured Streaming forms in ``pitwall.streaming``; readers and
decoders in ``pitwall.sources``; column expressions in ``pitwall.functions``; the
registered query plans in ``pitwall.plans``.
"""

__all__ = ["session"]
