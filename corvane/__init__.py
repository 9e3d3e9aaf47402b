"""Corvane: catalogue search, deduplication and corpus preparation on PySpark.

Subpackages: ``functions`` (Column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers), ``plans`` (registered queries and their SQL
oracles), ``streaming`` (Structured Streaming operators) and, optionally,
``llm`` (training-data operators; nothing else imports it).
"""

__version__ = "0.1.0"
