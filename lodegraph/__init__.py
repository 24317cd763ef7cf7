"""Spark-native analytics over document-centred knowledge graphs.

Node labels and edge types are DataFrames, every operation is a DataFrame
plan, and the driver only ever sees results whose size a request bounds.
"""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions shipped inside
# pandas UDFs travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
