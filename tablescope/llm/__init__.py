"""Operators for preparing training data.  Nothing else in the library imports this subpackage.

Functions that run inside tasks are sent by value, but some name modules of the library, so a cluster gets it by ``--py-files``.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
