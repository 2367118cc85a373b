"""Training-data operators (documents, pages, benchmark, labels)."""
