"""sluice: developer-assistant analytics on Spark.

Tables and streams of source files, chat messages, task requests, agent
execution logs and cache writes, processed with DataFrames, Spark SQL and
Structured Streaming. Operators are plain ``DataFrame -> DataFrame`` functions
in ``sluice.operators``; registered questions live in ``sluice.plans``.
"""

__version__ = "0.1.0"
