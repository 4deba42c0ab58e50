"""fieldwatch: a PySpark-native analytics engine for environmental sensor time series."""

import sys

from pyspark import cloudpickle

# functions that run on executors travel with their code, so that the package needs no installation there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
