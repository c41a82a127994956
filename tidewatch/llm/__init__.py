"""Operators of a training-data pipeline. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# functions sent to the workers carry their code, so workers need no installed copy
cloudpickle.register_pickle_by_value(sys.modules[__name__])
