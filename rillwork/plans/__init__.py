"""Ready-made flows built from the operators."""
