"""tidewire: a Spark-first engine for news intelligence and text-corpus preparation."""
