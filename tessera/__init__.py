"""Representation-response analytics on PySpark: DataFrame operators for identities, effects, geometry and metrics."""
