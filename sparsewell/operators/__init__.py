"""Matrix, vector, layout and validation operators on edge tables."""
