"""Reading and writing tables under a declared schema."""
