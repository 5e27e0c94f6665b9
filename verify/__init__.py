"""Registered queries on the driver tables and the SQL they are checked against."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
