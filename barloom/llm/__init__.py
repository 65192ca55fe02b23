"""Operators for preparing training text: one module per operator.

Nothing else in the library imports this subpackage. Its functions travel to the
workers by value, so an installation on the executors is not needed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
