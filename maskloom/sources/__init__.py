"""Reading and writing tables: CSV as text columns, parquet, and output names."""
