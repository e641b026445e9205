"""Runnable jobs: each has ``run(spark, config)``, a configuration file beside it and a command line, ``python -m jobs.<name>``."""
