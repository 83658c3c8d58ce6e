"""contactlake: a Spark-native engine for a company contact warehouse."""
