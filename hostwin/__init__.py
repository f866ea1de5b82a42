"""Host telemetry analytics on Spark: window features, datasets, models, evaluation."""
