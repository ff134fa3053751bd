"""rolegrid: job-posting collection, matching and review as Spark jobs."""
