"""lodestack: cataloguing files and searching them with Spark.

The package is organised by role: ``functions`` builds column expressions,
``operators`` turns DataFrames into DataFrames, ``sources`` reads the outside
world, ``plans`` parses queries and assembles them, ``streaming`` keeps tables
up to date.  ``engine.Engine`` ties them together.
"""

__version__ = "0.1.0"
API_VERSION = 1
