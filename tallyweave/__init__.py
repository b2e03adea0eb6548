"""Record linkage, amount-weighted scoring and panel analytics on Spark DataFrames."""

import os

# Matrices on the driver and in tasks are small; BLAS threads only fight with Spark's own and can
# hang a process that has started a JVM. Takes effect if NumPy is not loaded yet.
os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")

__version__ = "0.1.0"
