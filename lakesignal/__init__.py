"""Model-quality and document analytics as Spark jobs.

Every public function takes DataFrames and returns DataFrames.  Sub-packages:

* ``functions``  column functions (distribution tails, text and vector helpers)
* ``operators``  single operators (drift detectors, chunking, rules, retrieval, ...)
* ``sources``    readers and writers (telemetry, evaluation sets, registry tables)
* ``plans``      operators composed into whole checks and reports
* ``streaming``  the same checks on ``readStream`` sources
"""

__version__ = "0.1.0"
