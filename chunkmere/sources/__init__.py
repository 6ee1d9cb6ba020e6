"""Sources: repositories of files, and storages by URL."""
