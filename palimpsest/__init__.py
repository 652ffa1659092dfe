"""palimpsest: find, pseudonymise and restore sensitive text with Spark."""
