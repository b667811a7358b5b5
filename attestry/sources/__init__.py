"""Tables of the engine on shared storage."""
