"""Operators for preparing training data, and the queries that apply them.

Nothing else in the library imports this subpackage. Functions that run in
Python workers are pickled by value, so workers need neither ``--py-files`` nor
a particular working folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
