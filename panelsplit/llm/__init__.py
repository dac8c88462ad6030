"""Operators of a training-data pipeline: one module per operator, each with a general interface.

The modules' functions run inside Spark tasks. They are pickled by value, so an executor needs no
copy of this package on its path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
