"""Understanding queries, and whole searches built of the operators."""
