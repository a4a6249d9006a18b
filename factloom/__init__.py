"""factloom: a Spark-first engine for evidence-grounded facts.

Everything is a DataFrame in and a DataFrame out.  Sub-packages:

* ``functions``  Column -> Column expressions (units, periods, names, scope, text, vectors)
* ``sources``    readers, schemas, stores
* ``operators``  joins, gates, cascades, folds and other table operators
* ``plans``      named queries over the test tables with their SQL counterparts
* ``streaming``  incremental ingest
"""
