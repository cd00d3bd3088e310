"""File sources, sinks and the named dataset store."""
