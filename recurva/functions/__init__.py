"""Column functions: coercion, normalisers, similarity scores and labels."""
