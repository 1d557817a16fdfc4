"""A Spark engine for searching filings and analysing statements."""
