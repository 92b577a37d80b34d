"""wattframe: Spark jobs for metered building and resource usage."""

from wattframe.roles import METERED, Roles

__all__ = ["METERED", "Roles"]
