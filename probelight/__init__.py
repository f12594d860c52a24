"""Audits of logged decisions and paired experiments, as Spark jobs."""
