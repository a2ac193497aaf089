"""sedimenta: a PySpark engine that curates document collections.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (column expressions), ``operators``
(DataFrame -> DataFrame), ``plans`` (composed pipelines and the registered queries), ``streaming``
(Structured Streaming forms) and the optional ``llm`` (training-data operators), which nothing else imports.
"""
