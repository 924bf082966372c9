"""Column functions: text, JSON, vectors. All stay inside Catalyst unless their docstring says otherwise."""
