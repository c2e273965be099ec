"""Operators for training-data pipelines over `documents`, `embeddings` and `conversations`.

Executor functions of this subpackage travel with their code, so executors need not have it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
