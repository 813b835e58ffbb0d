"""Training-data operators: ten methods over documents, pages and their texts."""
