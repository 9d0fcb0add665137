"""netsentry: intrusion-analytics feature engineering, clustering and
classification of delimited event records, in batch and on streams,
expressed as Spark DataFrame plans and ``pyspark.ml`` stages."""

__version__ = "0.1.0"
