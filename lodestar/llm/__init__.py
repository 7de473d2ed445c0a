"""Training-data operators: ten corpus-scale operators and the queries that apply them."""
