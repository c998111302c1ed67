"""Reading sheets, projecting the star tables into sheets, and writing tables."""
