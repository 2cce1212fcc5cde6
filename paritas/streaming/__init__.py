"""An extension: selection rates over windows of a stream of events."""
