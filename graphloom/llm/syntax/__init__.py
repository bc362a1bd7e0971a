"""Error-correcting chart parsing of source files."""
