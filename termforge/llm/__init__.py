"""Operators for building language-model training data, one module each.

Nothing else in the library imports this subpackage.
"""

import sys

from pyspark import cloudpickle

# The functions travel to the executors with the tasks, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
