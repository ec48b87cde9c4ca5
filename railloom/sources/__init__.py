"""Readers and writers of timetable tables, and views over plain event tables."""
