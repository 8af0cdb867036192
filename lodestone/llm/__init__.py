"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Its functions are shipped to the
executors by value, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
