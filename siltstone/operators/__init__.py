"""DataFrame operators, one module for each step of the analysis."""
