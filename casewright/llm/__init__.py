"""Operations of a training-data pipeline: one module per operator, queries in ``queries.py``.

Functions that run in tasks travel with them, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
