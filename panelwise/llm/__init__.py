"""Training-data operators. Self-contained: nothing else in the library imports this package."""
