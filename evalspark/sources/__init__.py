"""Sources and sinks: JSON lines, manifests, prices, panels, published tables, Markdown tables."""
