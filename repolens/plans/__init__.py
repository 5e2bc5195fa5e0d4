"""The query catalogue: operators bound to tables, each with the SQL it is held against."""
