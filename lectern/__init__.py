"""lectern: corpus analytics for lecture transcripts, notes, courses and frames, on Spark.

Every operator is a ``DataFrame -> DataFrame`` function; see README.md for the map.
"""

__version__ = "0.1.0"
