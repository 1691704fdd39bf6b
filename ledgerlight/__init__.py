"""Ledgerlight: DataFrame-in, DataFrame-out analytics for sales, price and listing data."""
