"""lexloom: Spark-first analytics for subword vocabularies, corpora and training metrics."""
