"""Column functions: vectors, matrices, colours, splines, barycentric coordinates and transformations."""
