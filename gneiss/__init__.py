"""gneiss: distributed collections, word counts, graph ranks and linear models on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from gneiss.operators.dataset import Dataset
from gneiss.sources.readers import from_list, hdfs, load, mongodb, parquet, start, stop

__all__ = ["Dataset", "from_list", "hdfs", "load", "mongodb", "parquet", "start", "stop"]

# Executors get the package's functions with each task, so that nothing needs to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
