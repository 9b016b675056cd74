"""Training-data operators over the tables documents, embeddings, benchmark and labels."""
