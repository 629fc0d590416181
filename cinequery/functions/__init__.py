"""Column expressions: binary fields, headers, signal and time."""
