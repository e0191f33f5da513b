"""Rental-market analytics and training-data preparation as plain PySpark."""
