from panelcast.sources.panel import load_panel

__all__ = ["load_panel"]
