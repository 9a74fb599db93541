"""The named queries over the driver tables, and the SQL that each is held against."""
