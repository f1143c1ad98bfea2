"""Column, window and statistics helpers shared by the operators."""
