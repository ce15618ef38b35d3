"""Column functions: element-wise, on arrays within a row, random numbers and distributions."""
