"""Step reuse for registered queries.

The analysed application materialises each step (tokens, dictionary, bag of
words, model) once per run and later steps read it. Registered queries do the
same: a step's result is written once per (application, data folder, parameters) and
read by every query that needs it, until a file of the data folder changes.
"""

from __future__ import annotations

from pyspark.sql import functions as F

_STEPS: dict = {}


def files_state(spark, folder: str) -> tuple:
    """Number and hash of the paths, times and lengths of all files in a folder; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return tuple(files.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("path", "modificationTime", "length"))).first())


def step(spark, name: str, sf_dir: str, build, *params):
    key, state = (spark.sparkContext.applicationId, name, sf_dir, params), files_state(spark, sf_dir)
    if key not in _STEPS or _STEPS[key][0] != state:
        _STEPS[key] = (state, build())
    return _STEPS[key][1]
