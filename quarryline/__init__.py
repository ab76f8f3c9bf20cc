"""quarryline: retrieval, grounding and text analytics as Spark plans.

Subpackages: ``functions`` (Column -> Column), ``operators`` (DataFrame -> DataFrame), ``sources``
(readers and writers), ``plans`` (whole queries over the driver's tables, each with its SQL),
``streaming`` (Structured Streaming forms).
"""
