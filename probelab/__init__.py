"""probelab: Spark-native analytics for probing labelled text collections.

Layout
------
sources/    readers, sinks, the question catalogue, resume (skip-if-done)
functions/  column expressions: text cleaning, prompts, log-sum-exp, scalar stats
operators/  DataFrame -> DataFrame operators: preparation, folds, features,
            scoring, many-model cross-validation, metrics, TF-IDF, zero-shot,
            statistics, curves
plans/      compositions: the full analysis and report tables
streaming/  the scoring job as an incremental (availableNow) stream
"""

__version__ = "0.1.0"
