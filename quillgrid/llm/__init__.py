"""Training-data operators: ten components over documents, embeddings and labels."""
