"""Scans of snapshots, registers, geometry and timetables into DataFrames, and the sinks."""
