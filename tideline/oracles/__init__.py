"""DuckDB SQL used to check every SQL-expressible query."""
