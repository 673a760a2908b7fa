"""Participant-separated evaluation of sensor panels, written as Spark tables in, tables out."""
