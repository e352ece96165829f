"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general DataFrame interface; ``queries`` holds the thin
``opN_*`` queries and their SQL twins.
"""

import sys

from pyspark import cloudpickle

# functions travel to the executors with the job; the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
