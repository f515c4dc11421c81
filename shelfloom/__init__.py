"""Digital-shelf analytics and training-corpus preparation as Spark jobs."""
