"""Column expressions shared by the other packages."""
