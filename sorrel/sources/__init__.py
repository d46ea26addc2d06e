"""Reading sources and notes, publishing tables, exporting."""
