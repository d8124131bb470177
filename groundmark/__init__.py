"""groundmark: spot-landing measurement data, scoring and corpus preparation as Spark jobs."""
