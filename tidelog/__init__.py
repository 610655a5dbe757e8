"""tidelog: change-data-capture analytics on PySpark.

Change events in, versioned tables out, and answers about their current state:
merge semantics, reconciliation, dead-letter analysis, pipeline metrics and BI
queries, all as DataFrame / Spark SQL / Structured Streaming jobs.
"""
