"""Reading and writing lists and documents."""
