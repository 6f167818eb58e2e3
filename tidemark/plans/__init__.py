"""Commands composed of operators."""
