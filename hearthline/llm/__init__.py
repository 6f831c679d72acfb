"""Operators of a training-data pipeline: one module per operator, each with its query.

Nothing else in the library imports this subpackage.  Python that runs in tasks
is sent by value, so that executors need not have the package installed.
"""

from ..session import ship_by_value

ship_by_value(__name__)
