"""Early-warning analytics on entity x period panels, written for Spark."""

from panelcast.spec import PanelSpec

__all__ = ["PanelSpec"]
