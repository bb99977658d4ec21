"""Package-ecosystem analytics as composable Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with their code: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
