"""karst: a Spark-first engine for catalogue-style scientific queries, retrieval and training-data preparation."""
