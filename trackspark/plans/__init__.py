"""Named queries, each a DataFrame function with the SQL it is checked against."""
