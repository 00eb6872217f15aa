"""The registered queries as plain SQL for an independent engine."""
