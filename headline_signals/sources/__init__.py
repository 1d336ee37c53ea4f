"""Sources and sinks: driver tables, adapter views, files, HTML pages, market series."""
