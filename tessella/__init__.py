"""Spark-first analytics over observation tables, and text preparation at corpus scale.

Task functions defined in this package are pickled by value, so executors need
no copy of it on their own Python path.
"""
import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
