"""Sky, terrain, night-light and weather table jobs for PySpark.

Every public job takes and returns DataFrames; see README.md for the map of
modules.  Angles are degrees unless a name says otherwise.
"""
