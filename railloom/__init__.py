"""railloom: timetable analytics and journey planning on Spark DataFrames."""
