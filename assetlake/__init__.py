"""assetlake: dataset curation and analytics as plain Spark DataFrame jobs."""
