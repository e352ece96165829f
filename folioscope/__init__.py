"""folioscope: document fidelity analytics and training-data preparation on Spark."""

import sys

from pyspark import cloudpickle

# functions travel to the executors with the job; the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
