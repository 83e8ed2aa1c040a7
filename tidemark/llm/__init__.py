"""Training-data operators on texts and vectors; optional, nothing else in the library imports it."""
