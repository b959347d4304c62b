"""verdigris: traceable documents and append-only event logs on Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry this package's code with them: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
