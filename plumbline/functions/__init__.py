"""Column functions and the fixed lookup tables they use."""
