"""Named analyses: each returns the DataFrame behind one chart or table."""
