"""Operators for preparing training data. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Functions travel to the workers by value, so that these need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
