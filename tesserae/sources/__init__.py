"""Sources and sinks: files, the index store, chat models, web search."""
