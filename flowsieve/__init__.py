"""Alert triage for network event logs, written for Spark.

Sub-packages: ``sources`` (scans and sinks), ``functions`` (column expressions),
``operators`` (DataFrame -> DataFrame steps), ``plans`` (whole jobs built from the
operators), ``streaming`` (the same scoring on a live stream) and ``catalog``
(the registered queries with their SQL twins).
"""
