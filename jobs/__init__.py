"""Runnable jobs: each module has ``run(spark, config)`` and a command line."""
