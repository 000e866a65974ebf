"""Reading landed extracts and writing results."""
