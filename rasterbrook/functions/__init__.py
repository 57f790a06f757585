"""Column expressions: bytes and bits, codec constants and arithmetic."""
