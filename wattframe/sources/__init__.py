"""Reading and writing: CSV files, stored tables, stored models."""
