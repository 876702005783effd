"""How plans are put together: roles of tables, broadcast checks, the query registry, the search envelope."""
