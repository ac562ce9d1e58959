"""Where results go: JSON documents, tables and workbooks."""
