"""srcframe: code-corpus analytics as Spark DataFrame operators.

Every operator is a function from DataFrames (or Columns) to a DataFrame
(or Column).  All tables carry ``repo_id`` as the leading key, so one job
analyses many repositories at once.
"""

from srcframe.session import get_spark, ensure_checkpoint_dir  # noqa: F401

__version__ = "0.1.0"
