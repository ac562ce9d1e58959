"""tracelake: a Spark-native data dictionary and field-lineage engine."""
