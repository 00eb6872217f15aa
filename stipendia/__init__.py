"""Payroll analytics as Spark DataFrame transforms and spark.ml pipelines."""
