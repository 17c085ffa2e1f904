"""Text of office documents, as plain functions of bytes and as a column."""
