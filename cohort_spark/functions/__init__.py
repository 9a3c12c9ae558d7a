"""Column expressions: geometry, series attributes, sampling, arrays, probabilities and text."""
