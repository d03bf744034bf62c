"""Survey tabulation, checking, recoding and weighting on Spark DataFrames."""
import sys

from pyspark import cloudpickle

# the two small UDF modules travel with their tasks: executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
