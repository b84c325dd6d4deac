"""meshloom: backbone network planning as Spark DataFrame jobs.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and writers), ``plans`` (registered queries
and their SQL oracles), ``streaming`` (incremental extension) and the optional
``llm`` (training-data operators; nothing else imports it).
"""
