"""Operator-geometry analytics on Spark."""

import os

# Tasks are the parallelism: BLAS threads of many Python workers would only fight for the cores.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
