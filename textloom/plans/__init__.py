"""How plans keep their intermediate results."""
