"""earshot: few-shot evaluation and speech-corpus data operators on Spark.

Every public function takes and returns DataFrames or Columns; nothing runs until
the caller triggers an action, except where a docstring says that a size is checked.
"""

import sys

from pyspark import cloudpickle

# Send the package's Arrow functions to the executors by value, so that a cluster
# needs no installed copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
