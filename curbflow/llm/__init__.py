"""Operators of a large-scale training-data pipeline.

Functions that run inside tasks travel with the task, so Python workers need no copy of
this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
