"""millrace: data-parallel collection analytics expressed as Spark DataFrame plans."""

from millrace.operators.flow import Flow
from millrace.session import local_session

__all__ = ["Flow", "local_session"]
