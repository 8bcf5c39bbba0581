"""Dashboard queries composed of the operators."""
