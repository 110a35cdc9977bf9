"""Operators on DataFrames. Series are long tables: key columns, a date, a value; missing values are null."""
