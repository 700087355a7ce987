"""Spark-first analytics over messy multi-source directory data.

Sub-packages: ``functions`` (Column builders), ``operators`` (DataFrame in,
DataFrame out), ``sources`` (scans, parsers, sinks), ``plans`` (named analytics
and their SQL twins), ``streaming`` (Structured Streaming forms) and ``llm``
(training-data operators; nothing else imports it).
"""
