"""Spark-native shop analytics: cleaning, star-schema loads, features, KPIs, sentiment, quality."""

import sys

from pyspark import cloudpickle

# Functions handed to Python tasks travel with the job, so that executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
