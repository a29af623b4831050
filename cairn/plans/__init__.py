"""The registered queries over the star-schema tables, and the SQL that each is held against."""
