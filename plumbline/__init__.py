"""Design-conformance and drift analytics expressed as Spark jobs."""
