"""Column functions and Arrow kernels for multilingual legal text."""
