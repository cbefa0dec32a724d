"""Column functions: text, numbers, markers, draws, 3x3 Gaussian algebra."""
