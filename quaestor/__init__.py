"""Corpus analytics on Spark: versioned records, passages, hybrid search, cited answers, quotas."""
