"""Find leaked credentials in text tables and text streams with PySpark.

Every operator takes and returns DataFrames; every function takes and returns Columns.
"""
