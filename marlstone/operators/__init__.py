"""Rules that are not those of ANSI SQL, as expressions."""
