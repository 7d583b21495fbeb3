"""Repository-readiness analytics as Spark DataFrame pipelines."""
