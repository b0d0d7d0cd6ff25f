"""quarterlens: retail financial analytics as Spark DataFrame jobs.

Sub-packages
  functions  column expressions (null / infinity policy, exact ranks and quantiles)
  sources    landing readers, sinks and the test-table adapter
  operators  preparation, merge, summaries, score, exploration, models, report
  plans      composite jobs and the registered query catalog
  streaming  incremental landing of monthly report files
"""

__version__ = "0.1.0"
