"""Incremental scoring of explanation maps with Structured Streaming.

The benchmark has no streams: maps are written per (model, explainer) and
scored afterwards.  When maps land as files over time, the row-wise metrics
(complexity, sparseness) apply unchanged to a file stream, and the score
summary becomes a streaming aggregation whose state is one row per
(model, explainer, metric).  Checkpoints live in the shared checkpoint folder.
"""

from salient.streaming.scoring import score_map_stream, summary_stream  # noqa: F401
