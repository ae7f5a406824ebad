"""Training-data operators. Nothing outside this folder imports it.

Functions of this package are shipped to Python workers by value, so that
executors need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
