"""Spark-native engine for bibliographic record data.

The core packages (``sources``, ``functions``, ``operators``, ``plans``,
``streaming``) stand on their own.  The optional subpackage ``llm`` adds the
operators of a training-data pipeline; nothing in the core imports it.
"""

__version__ = "0.1.0"
