"""Readers and writers: CSR files, CSR/CSC text, edge lists, values in vertex order, generated graphs."""
