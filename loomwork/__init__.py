"""Loomwork: a Spark-first analytics engine.

A thin layer over ``SparkSession``: dialect translation, operator families as
DataFrame functions, extra sources and sinks, and the few rewrites that
Catalyst lacks.  ``loomwork.llm`` holds operators for training-data pipelines;
nothing else in the package imports it.
"""

__version__ = "0.1.0"
