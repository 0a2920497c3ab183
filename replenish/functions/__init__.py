"""Column-expression and metadata helpers shared by every operator."""
