"""Operators for preparing training text at scale, one module each.

Nothing outside this package imports it. Functions that run inside Python
workers are pickled by value, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
