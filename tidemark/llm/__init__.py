"""Operators for preparing language-model training corpora.

Nothing outside this package imports it.  Executors receive its Python code by
value, so a cluster needs numpy, pyarrow and pyahocorasick but no installed copy
of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
