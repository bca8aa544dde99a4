"""Training-data operators: one module for each, and `queries` that binds them to the documents, pages and other tables."""
