"""Account-panel cash-flow analytics on Spark.

Every operator is a DataFrame-in, DataFrame-out function keyed by ``account_id``.

* ``sources``   -- statement rows, panel files, table sinks, constraint checks
* ``functions`` -- column expressions and small array kernels used inside tasks
* ``operators`` -- labelling, roll-ups, recurrence, features, folds, metrics, models, bands
* ``plans``     -- end-to-end workflows composed from the operators
"""
