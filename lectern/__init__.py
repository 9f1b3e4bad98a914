"""Document analytics on Spark: hierarchy, cleaning, keyword indexes, retrieval and evaluation as DataFrame operators."""
