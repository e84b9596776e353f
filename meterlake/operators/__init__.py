"""Relational operators over the usage fact table: DataFrame in, DataFrame out."""
