"""Column functions: Column in, Column out, no Python at run time."""
