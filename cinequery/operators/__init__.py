"""Container relations: scans, joins, windows and validation on DataFrames."""
