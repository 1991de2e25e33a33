"""Column functions: numeric text, element-wise mathematics over arrays, vectors held in arrays."""
