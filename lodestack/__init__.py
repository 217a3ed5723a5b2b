"""lodestack: DataFrame operators for large document corpora and the tables around them."""
