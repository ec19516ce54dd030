"""Training-data operators on the documents, conversations, pages and embeddings tables."""
