"""salient — attribution-map analytics on Spark.

Inputs, predictions, attribution maps and scores are keyed DataFrames:

* samples       ``(sample_id BIGINT, x ARRAY<DOUBLE>, label INT)``
* long maps     ``(sample_id BIGINT, pos INT, v DOUBLE)``
* weights       ``(layer_idx INT, layer_name STRING, cls INT, pos INT, w DOUBLE)``
* scores        ``(sample_id BIGINT, score DOUBLE)``

Everything is expressed with DataFrame operators (joins, windows, array
functions, group-by estimators).  Python workers run only for user scorers and
the small per-sample linear solves of the regression explainers.
"""

from salient.session import get_spark, scratch_path  # noqa: F401

__version__ = "0.1.0"
