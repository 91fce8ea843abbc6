"""Raw-shaped feeds derived from the driver's tables, and the SQL to compare with."""
