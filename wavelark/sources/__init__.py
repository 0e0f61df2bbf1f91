"""Series built from tables, and a synthetic one."""
