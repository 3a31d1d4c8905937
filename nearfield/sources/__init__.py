"""Reading and writing vector tables, index folders and foreign binary files."""
