"""The engine on streams: demand, surges, keyed pricing state and sinks."""
