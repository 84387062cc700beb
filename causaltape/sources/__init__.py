"""Reading, checking and writing tables of ticks and bars."""
