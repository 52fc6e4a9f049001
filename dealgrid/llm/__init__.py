"""Training-data operators.

Their tasks run functions of this subpackage. The functions are pickled by value
with the tasks, so executors need no installed copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
