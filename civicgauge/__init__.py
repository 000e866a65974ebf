"""Public-sector style indicators (prize challenges, staffing, hiring, open source) as Spark DataFrame jobs."""
