"""lodestone: content-detection analytics expressed as Spark DataFrame pipelines."""
