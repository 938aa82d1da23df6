"""Sources, sinks and codecs."""
