"""Sources: tables by name, spreadsheets, folders of files and caches."""
