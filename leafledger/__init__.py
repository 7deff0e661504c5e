"""Spark operators for versioned document collections ("vaults").

Every operator is a plain ``DataFrame -> DataFrame`` function. ``vault_id`` leads
every key, times are Unix milliseconds passed in as parameters, rejections are
rows with a ``reason`` and never exceptions.
"""

import sys

from pyspark import cloudpickle

# Python functions of this package travel to executors by value, so a cluster needs no
# installed copy of it and a driver may start from any folder.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
