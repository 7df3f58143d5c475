"""freshet: Spark-first operators for irregularly sampled environmental measurements.

Sub-packages
------------
functions   scalar column expressions
operators   DataFrame -> DataFrame operators
sources     readers, record parsers and sinks
plans       registered queries with their ANSI-SQL counterparts
streaming   structured-streaming variants
llm         optional operators for model-training data; nothing outside it imports it
"""

__version__ = "0.1.0"
