"""Column functions.  All of them are built from native expressions."""
