"""Writing files and tables."""
