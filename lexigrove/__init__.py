"""lexigrove: a Spark-native engine for structured text retrieval.

The package compiles a structured query language to ordinary DataFrame plans
over columnar token, posting, field-extent and statistics tables, and carries
the analytics and streaming operators built on them.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
