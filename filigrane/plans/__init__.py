"""The query catalogue: every operator applied to the tables, with SQL that says the same."""
