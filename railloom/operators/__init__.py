"""DataFrame operators over timetables, stops, transfers and labels."""
