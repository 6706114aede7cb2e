"""Match analytics as Spark jobs: every step is a DataFrame -> DataFrame function."""
