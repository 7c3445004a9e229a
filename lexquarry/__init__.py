"""Document analytics on Spark: pages, positional index, lexical search, context pruning."""
