"""silvaspark: a PySpark-native engine for forest laser-scan point clouds.

Layout
------
``sources``    readers and writers (ASCII, PCD, PLY, LAS, CSV, transforms, configuration)
``functions``  column expressions and vectorised scalar kernels
``operators``  DataFrame operators: terrain, voxels, joins, clustering, matching, statistics
``plans``      composite plans (extract, compare, register) and the registered queries
"""

__version__ = "0.1.0"
