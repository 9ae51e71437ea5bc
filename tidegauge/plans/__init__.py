"""Named queries over the shared tables, and the SQL that they are held against."""
