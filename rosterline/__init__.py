"""Directory records from stored web pages, as Spark column expressions and DataFrame operators."""
