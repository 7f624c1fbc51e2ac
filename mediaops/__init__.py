"""Spark jobs over the data of a video upload and analysis service.

DataFrame in, DataFrame out. Every job that depends on "now" takes it as an
argument, and every ordering ends in a unique key, so results are repeatable.
"""

import sys

from pyspark import cloudpickle

# Python functions that run inside tasks travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
