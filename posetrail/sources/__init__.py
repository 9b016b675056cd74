"""Files of projects, poses, labels and notes, read and written by Spark.

A path may be a file, a folder or a pattern in any store that Spark reads. Small side files (project, maps, metadata) are read whole on
the driver; tables never are.
"""
