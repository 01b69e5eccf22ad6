"""Reading and writing networks, and a street grid derived from business tables."""
