"""Reading tables, files and seeds; writing and merging."""
