"""Training-data operators. Nothing else in the library imports this subpackage.

Functions that run in Python workers travel with the query, so the workers need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
