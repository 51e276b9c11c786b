"""Column functions: text normalisation, keys, vectors, sequences, edit distances."""
