"""tessera: automatic tabular analytics and learning as Spark jobs.

Every operator is a DataFrame -> DataFrame step (or a small aggregate that
produces fitted parameters); Catalyst and the executors do the work, the
driver only sees fitted scalars and small dictionaries.
"""

__version__ = "0.1.0"
