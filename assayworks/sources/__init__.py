"""Reading evidence files into tables, and writing results."""
