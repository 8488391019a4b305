"""Training-data operators over corpora of documents and pages."""
