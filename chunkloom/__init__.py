"""chunkloom: a Spark-native engine for deduplicated storage analytics."""
