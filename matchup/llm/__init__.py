"""Training-data operators: one module per operator, ``registry`` lists their queries."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
